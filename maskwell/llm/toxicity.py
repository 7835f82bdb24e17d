"""Toxicity from a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, replaces letters of other scripts that look like Latin ones, and reads digits and signs inside words
as the letters they stand for. What isn't a letter or digit becomes one space, so that terms can ask for the begin or the
whole of a word. The lexicon's terms are words and word beginnings that labelled toxic texts have significantly more
often; a term's weight is its smoothed log-odds. Matches inside exception phrases don't count. The weight found,
its share of the text's length, and whether there is any at all, give the score through a logistic regression.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices, table, text_of
from .labelled import TRAIN_ROWS, held_out, logistic, training_rows

# Letters of other scripts and their Latin look-alikes, after Unicode's lists of confusable characters and,
# for Cyrillic and Greek, common transliteration; what digits and signs stand for inside words.
LOOKS_LIKE = {
    "абвгдезиіїјкӏмнорстуүхшѕһԁԛԝѵьё": "abvrdezuiijklmhopctyyxwshdqwvbe",
    "αβγδεζηικμνοπρστυχω": "abydeznikuvonpotuxw",
    "ɑɡıɩʀɴɢʜɪʟʏʙᴀᴄᴅᴇᴊᴋᴍᴏᴘᴛᴜᴠᴡᴢꜰꜱøđłŧħɓɗɛɔ": "agiirnghilybacdejkmoptuvwzfsodlthbdeo",
    "օսոհցզ": "ounhgq",
}
WRITTEN_AS = {"ß": "ss", "æ": "ae", "œ": "oe", "ƨ": "s"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
#: Marks that combine with a letter, and characters without a width.
UNSEEN = re.compile("[\u0300-\u036f\u0483-\u0487\u00ad\u200b-\u200f\u2060\ufeff]")
#: Harmless phrases around words of the lexicon.
EXCEPTIONS = ("trash can", "trash bag", "trash bin", "pond scum", "soap scum", "clown fish", "sore loser bracket", "idiot proof")

FOLD = {ord(a): b for odd, plain in LOOKS_LIKE.items() for a, b in zip(odd, plain, strict=True)} | {ord(a): b for a, b in WRITTEN_AS.items()}
#: A word with digits or signs before letters, or with two at its end. It begins where its letters do, and gives none back.
SUBSTITUTED = re.compile(r"(?<![^\W\d_])(?:[^\W\d_]*+(?:[0134578@$!]++[^\W\d_]++)++(?:[0134578@$]{1,2}(?!\w))?|[^\W\d_]++[0134578@$]{2}(?!\w))")
STANDS_FOR = str.maketrans(DIGITS)
SIGN = re.compile("[0134578@$!]")
#: What parts words, and where a number begins at the end of one.
BREAKS, NUMBER = re.compile(r"[\W_]+"), re.compile(r"\d(?<=[^\W\d_]\d)")
PLAIN_BREAKS = {k: " " for k in range(128) if not chr(k).isalnum()}
ODD = re.compile("[^\x00-\x7f]+")
LONGEST, LEAST_G2 = 8, 24.0


class Plainer(dict):
    """A run of characters beyond ASCII to its folded form; None if that hangs on what is around it, as a sigma's does.

    A worker keeps the first short runs it meets, in about 10 MB.
    """

    MOST, LONGEST = 40_000, 32

    def __missing__(self, run: str) -> str | None:
        plain = unicodedata.normalize("NFKD", run)
        out = None if "Σ" in plain else UNSEEN.sub("", plain).lower().translate(FOLD)
        if len(self) < self.MOST and len(run) <= self.LONGEST:
            self[run] = out
        return out


PLAINER = Plainer()


def folded(text: str) -> str:
    """Folded words, one space around each.

    Compatibility forms (full-width, mathematical, small letters) become plain ones, marks on letters and characters
    without a width go, look-alikes become Latin, and digits and signs inside a word are read as letters.
    """
    text = text.lower()
    if not text.isascii():
        runs = {run: PLAINER[run] for run in set(ODD.findall(text))}
        if None in runs.values():
            text = UNSEEN.sub("", unicodedata.normalize("NFKD", text)).lower().translate(FOLD)
        else:
            text = ODD.sub(lambda m: runs[m[0]], text)
    if SIGN.search(text):
        text = SUBSTITUTED.sub(lambda m: m[0].translate(STANDS_FOR), text)
    text = NUMBER.sub(r" \g<0>", text)
    return f" {' '.join(text.translate(PLAIN_BREAKS).split()) if text.isascii() else BREAKS.sub(' ', text).strip()} "


def terms_of(text: str) -> set[str]:
    """Candidates: each word with its spaces, and its beginnings of 3 letters and more."""
    found = set()
    for word in set(folded(text).split()):
        if len(word) >= 3:
            found.add(f" {word} ")
            found.update(f" {word[:k]}" for k in range(3, min(len(word), LONGEST) + 1))
    return found


#: In place of a weight: the match is an exception phrase. Weights of terms are positive.
EXEMPT = -1.0


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    regression: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0, 0.0])

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 2, EXEMPT))
        if len(found):
            found.make_automaton()
        return found

    def features(self, text: str, automaton) -> tuple[float, float, float]:
        """Weight found (log scale), its share of the words, and whether there is any."""
        text = folded(text)
        hits = sorted((end - n + 1, end, weight) for end, (n, weight) in automaton.iter(text)) if len(automaton) else []
        # One sweep: a match lies in a phrase if one of those that begin at or before it also ends at or after it.
        total, phrases, k, reach = 0.0, sorted((a, b) for a, b, weight in hits if weight == EXEMPT), 0, -1
        for begin, end, weight in hits:
            while k < len(phrases) and phrases[k][0] <= begin:
                reach, k = max(reach, phrases[k][1]), k + 1
            if weight != EXEMPT and end > reach:
                total += weight
        return math.log1p(total), min(1.0, total / max(1, text.count(" ") - 1)), float(total > 0)

    def score(self, features) -> float:
        z = sum(w * x for w, x in zip(self.regression, (*features, 1.0), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def chosen_terms(rows, toxic: int, clean: int) -> dict[str, float]:
    """Of (term, texts with it that are toxic, that are clean) the significant ones; none begins with another."""
    def g2(a: int, b: int) -> float:
        share, out = (a + b) / (toxic + clean), 0.0
        for n, of in ((a, toxic), (b, clean)):
            for x, p in ((n, share), (of - n, 1 - share)):
                out += 2 * x * math.log(x / (of * p)) if x else 0.0
        return out

    good = {t: (a, b, g2(a, b)) for t, a, b in rows if a * clean > 8 * (b + 0.5) * toxic}
    out: dict[str, float] = {}
    begun: set[str] = set()  # the beginnings of all chosen terms
    # The most telling term of a family comes first: a beginning where its words together tell more, else the full word.
    for term in sorted(good, key=lambda t: (-round(good[t][2], 6), -len(t), t)):
        a, b, tells = good[term]
        if tells < LEAST_G2 or term in begun or any(term[:k] in out for k in range(4, len(term))):
            continue
        out[term] = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
        begun.update(term[:k] for k in range(4, len(term) + 1))
    return out


def learnt(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS, most: int = TRAIN_ROWS) -> Lexicon:
    """A lexicon with its weights and regression, from at most ``most`` labelled rows that aren't held out."""
    import numpy as np

    rows = training_rows(docs, labels, "toxic", most)
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    lexicon = Lexicon({}, exceptions)
    if not toxic or not clean:
        p = (toxic + 0.5) / (toxic + clean + 1)
        lexicon.regression = [0.0, 0.0, 0.0, float(np.log(p / (1 - p)))]
        return lexicon

    def count(batches):
        import pyarrow as pa

        tally: dict[str, list[int]] = {}

        def put():
            yield pa.RecordBatch.from_arrays([pa.array(list(tally)), pa.array([x[0] for x in tally.values()], pa.int64()), pa.array([x[1] for x in tally.values()], pa.int64())], names=["term", "a", "b"])

        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for term in terms_of(text):
                        tally.setdefault(term, [0, 0])[0 if label == 1 else 1] += 1
                if len(tally) > 400_000:
                    yield from put()
                    tally.clear()
        yield from put()

    counts = rows.select("text", "label").mapInArrow(count, "term string, a bigint, b bigint").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    share = (F.col("a") + F.col("b")) / (toxic + clean)
    tells = lambda x, n, p: F.when(x > 0, 2 * x * F.log(x / (n * p))).otherwise(0.0)
    g2 = tells(F.col("a"), toxic, share) + tells(toxic - F.col("a"), toxic, 1 - share) + tells(F.col("b"), clean, share) + tells(clean - F.col("b"), clean, 1 - share)
    # The significant terms, all of them: their number is bounded by the words of the training rows, of which there are `most`.
    likely = counts.where((F.col("a") * clean > 8 * (F.col("b") + 0.5) * toxic) & (g2 >= LEAST_G2 - 1e-6))
    lexicon.weights = chosen_terms([(r.term, r.a, r.b) for r in likely.collect()], toxic, clean)
    found = weighed(rows.withColumn("doc_id", F.col("label")), lexicon).toArrow()  # at most `most` rows of four numbers
    x = np.c_[[found[c].to_numpy() for c in ("f0", "f1", "f2")]].T
    lexicon.regression = logistic(x, found["doc_id"].to_numpy().astype(float)).tolist()
    return lexicon


def weighed(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id, f0, f1, f2, score`` for each row. The lexicon is bounded by its training rows."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    ready: dict = {}

    def run(rows: dict) -> dict:
        own = shared.value
        automaton = ready.get("automaton") or ready.setdefault("automaton", own.automaton())
        found = [own.features(t, automaton) for t in rows["text"]]
        return {"doc_id": rows["doc_id"], **{f"f{k}": [f[k] for f in found] for k in range(3)}, "score": [own.score(f) for f in found]}

    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    return map_slices(plain, run, "doc_id bigint, f0 double, f1 double, f2 double, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, exceptions: tuple[str, ...] = EXCEPTIONS, most: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Null and empty texts have no match and the score that goes with that. Without both labels among the training rows,
    the score is the smoothed share of label 1 for all. Repeated rows give equal rows; a null id is not held out; an
    empty table gives no rows. Only ids and texts are read.
    """
    found = weighed(docs, learnt(docs, labels, exceptions, most))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
