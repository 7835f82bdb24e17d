"""Token ids and counts as the tokenizers library gives them, for texts of any length.

Two facts about the vocabularies used here, checked by the tests against the library, carry everything:

* A *safe boundary* is a place before a space (U+0020) whose previous character is visible. Neither pre-tokenizer puts
  both sides of it into one piece, and neither looks back across it, so the tokens of a text are the tokens of its
  parts, one after the other.
* Texts repeat their parts. Where ids are wanted, a worker keeps the tokens of the short parts that it met first, up to a
  number of bytes, and encodes only the others. The word vocabulary drops white space and case, so there every space and
  line feed is a cut, and the parts of Latin-1 texts are kept in lower case.

Counts go through overlap resynchronisation: texts of more than a chunk are cut into overlapping chunks, each is encoded
with offsets, and two neighbours are spliced at a safe boundary inside their overlap at which both have a token boundary.
Where an overlap has no such place, it is widened. A chunk is a few thousand characters, so that ordinary long documents
are spliced, too, and an encoder never holds more than that unless a text has no safe boundary.
"""

from __future__ import annotations

import re
from array import array

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices, table, text_of

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
#: Characters of a chunk and of its first overlap; texts up to a chunk are encoded in one go.
CHUNK, OVERLAP = 4096, 128
#: Characters and ids, in bytes, that a worker keeps for known parts, and the longest part that it keeps.
MEMO_BYTES, MEMO_PART = 144 << 20, 64

#: A space after a character that is certainly visible: no separator, control or format character of any kind.
SAFE = re.compile(r"(?<=[!-~¡-¬®-˿Ͱ-ͷΆ-ҁҊ-ԯ]) ")
ODD = re.compile(r"(?<![!-~¡-¬®-˿Ͱ-ͷΆ-ҁҊ-ԯ]) ")
LETTERS = re.compile(r"[a-zß-öø-ÿ]+")
#: Letters between ASCII marks. An apostrophe before letters may belong to them.
MARKED = re.compile(r"([!-&(-/:-@\[-`{-~]*)([a-zß-öø-ÿ]+)([!-/:-@\[-`{-~]*)")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as one visible letter: itself where it is visible, else 256 and up in turn."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Coder:
    """One vocabulary file in one worker process."""

    _open: dict[str, Coder] = {}

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self.drops_space = self.library.normalizer is not None  # the word vocabulary; the byte vocabulary keeps spaces
        self.special = [t.content.lower() for t in self.library.get_added_tokens_decoder().values()]
        self.memo: dict[str, bytes] = {"": b""}
        self.room = MEMO_BYTES

    def keep(self, part: str, ids: bytes) -> None:
        """Remember the ids of a short part while there is room; an entry takes about 180 bytes beside its content."""
        if self.room < 180:
            return
        size = 180 + len(part) + len(ids)
        if len(part) <= MEMO_PART and size <= self.room and part not in self.memo:
            self.memo[part] = ids
            self.room -= size

    @classmethod
    def at(cls, path: str) -> Coder:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def library_ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def model_ids(self, run: str) -> bytes:
        """The ids of one pre-token that needs no normalisation, straight from the model."""
        return array("I", [t.id for t in self.model.tokenize(run.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def part_ids(self, part: str) -> bytes:
        """The ids of a part between safe boundaries, as native 32-bit numbers.

        Runs of lower-case Latin letters go to the model at once; they are one pre-token and need no normalisation.
        Anything else goes through the whole library.
        """
        if LETTERS.fullmatch(part[1:] if part[:1] == " " else part):
            return self.model_ids(part)
        return array("I", self.library_ids(part)).tobytes()

    def lowered(self, text: str) -> str | None:
        """A Latin-1 text in lower case, as the normalizer makes it; None for others and where that could make a special token."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        low = text.lower()
        for special in self.special:
            if special in low:
                return None
        return low

    def known(self, word: str) -> bytes:
        ids = self.memo.get(word)
        return self.low_ids(word) if ids is None else ids

    def low_ids(self, word: str) -> bytes:
        """The ids of a new word that ``lowered`` gave. What stands before and after its letters are pre-tokens of their own."""
        if LETTERS.fullmatch(word):
            ids = self.model_ids(word)
        elif found := MARKED.fullmatch(word):
            ids = b"".join(map(self.known, found.groups()))
        else:
            ids = array("I", self.library_ids(word)).tobytes()
        self.keep(word, ids)
        return ids

    def any_ids(self, word: str) -> bytes:
        """The ids of any new word."""
        low = self.lowered(word)
        ids = array("I", self.library_ids(word)).tobytes() if low is None else self.known(low)
        self.keep(word, ids)
        return ids

    def words(self, text: str) -> bytes:
        """The ids of a text, by its words; only for the word vocabulary, which drops the spaces between them."""
        low = self.lowered(text)
        text, new = (text, self.any_ids) if low is None else (low, self.low_ids)
        out, get = [], self.memo.get
        for word in text.replace("\n", " ").split(" "):
            ids = get(word)
            out.append(new(word) if ids is None else ids)
        return b"".join(out)

    def parts(self, text: str) -> list[str]:
        """The text cut at its safe boundaries; all parts but the first begin with a space."""
        found = text.split(" ")
        if ODD.search(text):
            found = SAFE.split(text)
        return [found[0], *[" " + p for p in found[1:]]] if len(found) > 1 else found

    def small(self, text: str) -> bytes:
        """The ids of a text, by its parts."""
        out, memo = [], self.memo
        for part in self.parts(text):
            ids = memo.get(part)
            if ids is None:
                ids = self.part_ids(part)
                self.keep(part, ids)
            out.append(ids)
        return b"".join(out)

    def chunk(self, text: str):
        """A chunk encoded by the library, with offsets."""
        return self.library.encode(text, add_special_tokens=False)

    def ids(self, text: str) -> bytes:
        """The ids of a text of any length, by its parts."""
        return self.words(text) if self.drops_space else self.small(text)

    def count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int, int]:
        """Tokens of a text, and how many splices and widenings it took to count them."""
        if len(text) <= chunk:
            return len(self.chunk(text)), 0, 0
        tokens, chunks, widened = 0, 0, 0
        for _, n, more in self.spliced(text, chunk, overlap):
            tokens, chunks, widened = tokens + n, chunks + 1, widened + more
        return tokens, chunks - 1, widened

    def spliced(self, text: str, chunk: int, overlap: int):
        """Yield (encoding, how many of its tokens count, widenings) for each chunk of the text in turn.

        ``begin`` is the last splice. The chunk from there on and the one after it share ``wide`` characters. The splice
        is the last safe boundary in the shared part at which the first chunk has a token boundary, and the second
        chunk, encoded from the start of the shared part, has one too. Without one, the shared part doubles, up to the
        rest of the text. Both chunks then agree on what lies between the splices.
        """
        begin, n = 0, len(text)
        while begin < n:
            wide, end, more = overlap, min(n, begin + chunk), 0
            coded = self.chunk(text[begin:end])
            while end < n:
                splice = self.splice(text, begin, max(begin + 1, end - wide), end, coded)
                if splice is not None:
                    break
                wide, more = 2 * wide, more + 1
                if wide > end - begin:  # no place in the whole chunk: it grows
                    end = min(n, end + wide)
                    coded = self.chunk(text[begin:end])
            if end == n:
                yield coded, len(coded), more
                return
            begin, count = splice
            yield coded, count, more

    def splice(self, text: str, begin: int, shared: int, end: int, coded) -> tuple[int, int] | None:
        """The last place in text[shared:end] at which both chunks may be cut, and how many tokens of the first precede it."""
        safe = [m.start() for m in SAFE.finditer(text, shared, end)]
        if not safe:
            return None
        later = self.chunk(text[safe[0] : end])
        step = 1 if self.drops_space else 0  # a dropped space belongs to no token; the next one begins after it
        for place in reversed(safe):
            if place > begin:
                first, second = self.begins(coded, place + step - begin), self.begins(later, place + step - safe[0])
                if first is not None and second is not None:
                    return place, first
        return None

    @staticmethod
    def begins(coded, at: int) -> int | None:
        """The first token that begins at a character, if one does."""
        token = coded.char_to_token(at)
        return token if token is not None and coded.token_to_chars(token)[0] == at else None


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, n_splices, n_widened`` for every row of ``docs``.

    ``n_splices`` and ``n_widened`` say how many chunk boundaries the count was put together at, and how often an overlap
    had to be widened for one. Null and empty texts have no bytes and no tokens. Repeated rows give equal rows, an empty
    table none; other columns are not read. ``path`` is a tokenizers file; without it, each worker looks up
    ``byte_bpe_50k.json``.
    """

    def run(rows: dict) -> dict:
        coder = Coder.at(path or tokenizer_path(BYTE_BPE))
        counts = [coder.count(t) for t in rows["text"]]
        return {"doc_id": rows["doc_id"], "n_bytes": rows["n_bytes"], "n_tokens": [c[0] for c in counts], "over_limit": [c[0] > limit for c in counts], "n_splices": [c[1] for c in counts], "n_widened": [c[2] for c in counts]}

    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"), F.octet_length(text_of()).cast("bigint").alias("n_bytes"))
    return map_slices(plain, run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, n_splices bigint, n_widened bigint")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
