"""Language-model scores from a log-frequency Bloom filter.

The filter holds word pairs together with their quantised counts: a pair with count c has level 1 + floor(log2 c), and
(pair, 1) ... (pair, level) are all entered. A reader probes level after level until one is missing and so learns the
count up to a factor, from bits alone. Every pair of the training texts is entered, those seen once too, whatever its
words; a text's end is a word as well.

Pairs are dealt by hash over shards, whose number follows the input, and each shard's bits are sized by its own entries,
so that the rate of false hits is the same at every size. One task counts a shard and builds its bits; a shard also keeps
the exact counts of its words. Where all shards together have at most ``BROADCAST`` bytes, they are broadcast. A larger
model is never broadcast: batches of texts then send the distinct pairs and words they ask for to the shards and get
levels and counts back. Both ways give the same rows. The most frequent words (``HEAD_WORDS`` of them at most) are broadcast
always, so that no question is asked for them.

A word w after v has the probability (c(v, w) + ``PRIOR`` * p(w)) / (c(v) + ``PRIOR``), where p(w) is the base's.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_crc, slices, small_batches, stage, table, text_of

HEAD_WORDS = 1 << 20
#: Bytes of a model that is broadcast whole, at most.
BROADCAST = 16 << 20
#: Text bytes of a shard, shards at least; bits for an entry, probes for an entry; tokens that a task adds up at once.
SHARD_BYTES, SHARDS, ENTRY_BITS, PROBES, CHUNK = 16 << 20, 64, 10, 5, 4_000_000
#: Text bytes of a batch that asks the shards; a longer text is one batch.
BATCH = 4 << 20
PRIOR = 50.0
END = b""
PLAIN = "doc_id bigint, held_out boolean, raw binary"


class Words(dict):
    """Word to 64-bit hash; a worker keeps the first short words it meets, in about 32 MB."""

    MOST, LONGEST = 200_000, 48

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word) - (1 << 63)
        if len(self) < self.MOST and len(word) <= self.LONGEST:
            self[word] = h
        return h


WORDS = Words()


def hashes(raws: list[bytes]):
    """Word hashes of the texts one after the other, each with its end token, and where each text begins.

    ``bytes.lower`` changes A-Z alone and ``bytes.split`` splits at exactly x20 and x09-x0D.
    """
    import numpy as np

    each = []
    for raw in raws:
        words = raw.lower().split()
        words.append(END)
        each.append(words)
    sizes = np.array([len(w) for w in each], np.int64)
    ids = np.fromiter((WORDS[w] for ws in each for w in ws), np.int64, int(sizes.sum()))
    return ids, np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64), sizes


def mixed(x, salt: int):
    """A 64-bit finaliser, array by array."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def middle(level):
    """The count that a level stands for: the mean of 2**(level-1) and 2**level - 1; 0 at level 0."""
    import numpy as np

    return np.where(level > 0, (np.exp2(level - 1) + np.exp2(level) - 1) / 2, 0.0)


def word_grams(ids):
    """48-bit numbers that deal words over shards."""
    import numpy as np

    return mixed(ids, 11) >> np.uint64(16)


def pair_grams(ids, starts):
    """48-bit numbers of the pairs that end at each token; a text's first word follows an end."""
    import numpy as np

    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[starts] = WORDS[END]
    return mixed(mixed(before, 7) ^ ids.astype(np.uint64), 13) >> np.uint64(16)


def bounds(grams, shards: int):
    """The shards that sorted grams fall in, and where each one's grams begin and end. Shards are ranges of grams."""
    import numpy as np

    shard = ((grams >> np.uint64(16)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    at = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else np.zeros(0, np.int64)
    return shard[at], at, np.r_[at, len(shard)][1:]


def steps(grams) -> bytes:
    """Sorted grams as the first one, then steps of four bytes; a step of 2**32 - 1 only carries on to the next."""
    import numpy as np

    if not len(grams):
        return b""
    most = np.uint64(0xFFFFFFFF)
    step = np.diff(grams)
    fill = (step // most).astype(np.int64)
    out = np.full(len(step) + int(fill.sum()), most, "<u4")
    out[np.cumsum(fill + 1) - 1] = step % most
    return grams[:1].astype("<u8").tobytes() + out.tobytes()


def from_steps(data: bytes):
    import numpy as np

    if not data:
        return np.zeros(0, np.uint64)
    step = np.frombuffer(data, "<u4", offset=8)
    at = np.cumsum(step, dtype=np.uint64)[step != 0xFFFFFFFF]
    return np.r_[np.uint64(0), at] + np.frombuffer(data, "<u8", 1)


def summed(keys, counts):
    """Distinct keys in order, and the sums of their counts."""
    import numpy as np

    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts[order], at) if len(at) else counts[:0]


def probes(grams, level: int, size: int):
    """The bits of (gram, level) among ``size`` bits, one array a probe."""
    import numpy as np

    a = mixed(grams, level)
    low = np.uint64(0xFFFFFFFF)
    at, step = a & low, a >> np.uint64(32) | np.uint64(1)
    for _ in range(PROBES):
        yield (at * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        at = at + step & low


def bits_of(grams, level) -> bytes:
    """A filter that holds each gram up to its level, at ``ENTRY_BITS`` bits an entry."""
    import numpy as np

    size = max(64, int(level.sum()) * ENTRY_BITS + 7 & ~7)
    flags = np.zeros(size, np.uint8)
    for n in range(1, int(level.max(initial=0)) + 1):
        for at in probes(grams[level >= n], n, size):
            flags[at] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def levels(bits: bytes | None, grams, most: int = 48):
    """The level of each gram by repeated probes: 0 where it isn't held."""
    import numpy as np

    out, live = np.zeros(len(grams), np.int64), np.arange(len(grams))
    if not bits:
        return out
    data = np.frombuffer(bits, np.uint8)
    for level in range(1, most):
        held = np.ones(len(live), bool)
        for at in probes(grams[live], level, len(data) * 8):
            held &= (data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        live = live[held]
        if not len(live):
            break
        out[live] = level
    return out


GATHERED = "shard bigint, words binary, grams binary, counts binary"
SHARD = "shard bigint, words binary, counts binary, bits binary, n_tokens bigint, n_words bigint"


def gathered(plain: DataFrame, shards: int) -> DataFrame:
    """Counts of words and pairs by shard; tasks add up before the shuffle, and a row has many of them packed."""

    def put(parts, name):
        import numpy as np
        import pyarrow as pa

        keys, n = np.unique(np.concatenate(parts), return_counts=True)
        grams = keys
        if name == "words":
            grams = word_grams(keys)
            order = np.argsort(grams)
            grams, keys, n = grams[order], keys[order], n[order]
        pack, counts = (steps if name == "grams" else lambda x: x.astype("<i8").tobytes()), n.astype("<u4")
        rows = [(s, pack(keys[i:j]), counts[i:j].tobytes()) for s, i, j in zip(*bounds(grams, shards), strict=True)]
        for k in range(0, len(rows), 500):
            some = rows[k : k + 500]
            packed, none = pa.array([x[1] for x in some], pa.binary()), pa.nulls(len(some), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in some], pa.int64()), *((packed, none) if name == "words" else (none, packed)), pa.array([x[2] for x in some], pa.binary())],
                names=["shard", "words", "grams", "counts"],
            )

    def run(batches):
        words, pairs, size = [], [], 0
        for b in batches:
            for part in slices(b, 2):
                ids, starts, _ = hashes(part.column(2).to_pylist())
                words.append(ids)
                pairs.append(pair_grams(ids, starts))
                size += len(ids)
                if size > CHUNK:
                    yield from put(words, "words")
                    yield from put(pairs, "grams")
                    words, pairs, size = [], [], 0
        if size:
            yield from put(words, "words")
            yield from put(pairs, "grams")

    return plain.mapInArrow(run, GATHERED)


def built(packed: DataFrame) -> DataFrame:
    """One row a shard: its words in order of their hashes, their exact counts, the filter of its pairs, totals."""

    def close(shard, words, pairs):
        import numpy as np
        import pyarrow as pa

        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        w, c = summed(*(np.concatenate(x) for x in zip(*(words or [none]), strict=True)))
        g, n = summed(*(np.concatenate(x) for x in zip(*(pairs or [(none[0].astype(np.uint64), none[1])]), strict=True)))
        bits = bits_of(g, np.frexp(n.astype(np.float64))[1].astype(np.int64))
        row = {"shard": shard, "words": w.astype("<i8").tobytes(), "counts": c.astype("<i8").tobytes(), "bits": bits, "n_tokens": int(c.sum()), "n_words": len(w)}
        types = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], names=list(row))

    def run(batches):
        import numpy as np

        at, words, pairs = None, [], []
        for b in batches:
            for r in b.to_pylist():
                if r["shard"] != at:
                    if at is not None:
                        yield close(at, words, pairs)
                    at, words, pairs = r["shard"], [], []
                n = np.frombuffer(r["counts"], "<u4").astype(np.int64)
                if r["words"] is not None:
                    words.append((np.frombuffer(r["words"], "<i8"), n))
                else:
                    pairs.append((from_steps(r["grams"]), n))
        if at is not None:
            yield close(at, words, pairs)

    return packed.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, SHARD)


def word_counts(shards: DataFrame) -> DataFrame:
    """``key, c``: the exact counts of all words, row by row."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for w, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(w, "<i8")), pa.array(np.frombuffer(c, "<i8"))], names=["key", "c"])

    return shards.select("words", "counts").mapInArrow(run, "key bigint, c bigint")


class Model:
    """What every worker has: the most frequent words with their counts, the number of shards, totals."""

    def __init__(self, head, head_counts, shards: int, total: int, distinct: int):
        self.head, self.head_counts, self.shards, self.total, self.distinct = head, head_counts, shards, total, distinct

    def in_head(self, ids):
        """Counts of head words, -1 for other words."""
        import numpy as np

        if not len(self.head):
            return np.full(len(ids), -1)
        at = np.searchsorted(self.head, ids)
        at[at == len(self.head)] = 0
        return np.where(self.head[at] == ids, self.head_counts[at], -1)


class Asked:
    """A batch of texts: its tokens and the distinct words below the head and pairs that it asks for, in shard order."""

    def __init__(self, model: Model, raws: list[bytes]):
        import numpy as np

        self.model = model
        self.ids, self.starts, self.sizes = hashes(raws)
        self.pairs, self.pair_at = np.unique(pair_grams(self.ids, self.starts), return_inverse=True)
        self.count = model.in_head(self.ids)
        self.tail = self.count < 0
        words, word_at = np.unique(self.ids[self.tail], return_inverse=True)
        grams = word_grams(words)
        order = np.argsort(grams)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.words, self.grams, self.word_at = words[order], grams[order], place[word_at]

    def questions(self):
        """``shard, words, pairs`` for each shard that is asked."""
        by: dict = {}
        for k, keys, grams in ((0, self.words, self.grams), (1, self.pairs, self.pairs)):
            for s, i, j in zip(*bounds(grams, self.model.shards), strict=True):
                by.setdefault(int(s), [self.words[:0], self.pairs[:0]])[k] = keys[i:j]
        return [(s, *by[s]) for s in sorted(by)]

    def scores(self, counts, level):
        """Of each text, known tokens, base score and score, from the counts of ``words`` and the levels of ``pairs``."""
        import numpy as np

        m = self.model
        self.count[self.tail] = counts[self.word_at]
        count = self.count.astype(np.float64)
        norm = m.total + m.distinct + 1
        ends = self.starts + self.sizes - 1
        context = np.empty_like(count)
        context[1:] = count[:-1]
        context[self.starts] = count[ends[0]] if len(ends) else 0
        seen = np.minimum(middle(level)[self.pair_at], context)
        model = np.log10((seen + PRIOR * (count + 1) / norm) / (context + PRIOR))
        add = lambda x: np.add.reduceat(x, self.starts) if len(x) else x
        return add((count > 0).astype(np.int64)), add(np.log10(count + 1)) - self.sizes * math.log10(norm), add(model)


def answered(shard: tuple | None, words, pairs):
    """Exact counts of ``words`` and levels of ``pairs`` in one shard ``(words, counts, bits)``; all 0 without one."""
    import numpy as np

    counts = np.zeros(len(words), np.int64)
    if shard is None:
        return counts, np.zeros(len(pairs), np.int64)
    own, n = np.frombuffer(shard[0], "<i8"), np.frombuffer(shard[1], "<i8")
    if len(own):
        at = np.searchsorted(own, words)
        at[at == len(own)] = 0
        counts = np.where(own[at] == words, n[at], 0)
    return counts, levels(shard[2], pairs)


RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def result(ids, held, asked: Asked, counts, level):
    import numpy as np
    import pyarrow as pa

    known, base, full = asked.scores(counts, level)
    columns = [ids, held, pa.array(asked.sizes), pa.array(known), pa.array(np.full(len(known), asked.model.total, np.int64)), pa.array(base), pa.array(full)]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in RESULT.split(", ")])


def cut(counts: DataFrame, most: int) -> int:
    """The least count c at which no more than ``most`` rows have a count of c or more.

    Counts are looked at in 16 steps an octave, so that a few hundred sums settle it.
    """
    step = F.floor(F.log2("c") * 16).cast("int")
    kept = 0
    found = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least"), F.max("c").alias("most")).orderBy(F.desc("step")).collect()
    least = 1
    for r in found:
        if kept + r.n > most:
            return r.most + 1
        kept += r.n
        least = r.least
    return least


def plain_documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (id_crc() % 7 == 2).alias("held_out"), text_of().cast("binary").alias("raw"))


def train(docs: DataFrame, head_words: int = HEAD_WORDS):
    """The model and the table of shards, from rows that aren't held out."""
    import numpy as np

    plain = plain_documents(docs).where("NOT held_out")
    size = plain.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    n = max(SHARDS, size // SHARD_BYTES)
    shards = stage(built(gathered(plain, n)), "shards")
    total, distinct = (x or 0 for x in shards.agg(F.sum("n_tokens"), F.sum("n_words")).first())
    words = word_counts(shards)
    if distinct > head_words:
        words = words.where(F.col("c") >= cut(words, head_words))
    top = words.toArrow()  # at most head_words rows
    order = np.argsort(top["key"].to_numpy())
    return Model(top["key"].to_numpy()[order], top["c"].to_numpy()[order], n, int(total), int(distinct)), shards


def by_broadcast(plain: DataFrame, model, shards: DataFrame) -> DataFrame:
    """Scores with all shards in every worker."""
    rows = shards.select("shard", "words", "counts", "bits").toArrow().to_pylist()  # at most BROADCAST bytes
    held = plain.sparkSession.sparkContext.broadcast({r["shard"]: (r["words"], r["counts"], r["bits"]) for r in rows})

    def run(batches):
        import numpy as np

        for b in batches:
            for part in slices(b, 2, 4096):
                asked = Asked(model.value, part.column(2).to_pylist())
                got = [answered(held.value.get(s), w, p) for s, w, p in asked.questions()]
                yield result(part.column(0), part.column(1), asked, np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got]))

    return plain.mapInArrow(run, RESULT)


def by_exchange(plain: DataFrame, model, shards: DataFrame) -> DataFrame:
    """Scores with each shard in one task: batches of texts send it what they ask for and get the answers back.

    Batches are written first, so their numbers stay. A task reads a shard, then the questions to it one by one; another
    reads a batch, then the answers to it. Both are sorted by Spark, which spills, and neither holds more than one batch
    and one shard.
    """

    def batched(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        n = TaskContext.get().partitionId() << 32
        for b in batches:
            for part in slices(b, 2, 4096, BATCH):
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pa.concat_arrays([part.column(k)])) for k in range(2)]
                raws = part.column(2).to_pylist()
                sizes, joined = pa.array([[len(r) for r in raws]], pa.list_(pa.int64())), b"".join(raws)
                zipped = pa.array([pa.compress(joined, "zstd", asbytes=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *lists, sizes, zipped], names=["batch", "doc_ids", "held", "sizes", "raws"])
                n += 1

    def texts_of(sizes, zipped):
        import pyarrow as pa

        whole, out, at = pa.decompress(zipped, sum(sizes), "zstd", asbytes=True), [], 0
        for n in sizes:
            out.append(whole[at : at + n])
            at += n
        return out

    texts = stage(plain.mapInArrow(batched, "batch bigint, doc_ids array<bigint>, held array<boolean>, sizes array<bigint>, raws binary"), "batches")

    def ask(batches):
        import pyarrow as pa

        for b in batches:
            for n, sizes, raws in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                rows = Asked(model.value, texts_of(sizes, raws)).questions()
                columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([n] * len(rows), pa.int64())]
                columns += [pa.array([r[1].astype("<i8").tobytes() for r in rows], pa.binary()), pa.array([steps(r[2]) for r in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "batch", "words", "grams"])

    def probe(batches):
        from itertools import groupby

        import numpy as np
        import pyarrow as pa

        at, shard = None, None
        for b in batches:
            out = []
            for number, rows in groupby(b.to_pylist(), key=lambda r: r["shard"]):
                asked = []
                for r in rows:
                    if r["batch"] < 0:
                        at, shard = number, (r["words"], r["counts"], r["bits"])
                    else:
                        asked.append((r["batch"], np.frombuffer(r["words"], "<i8"), from_steps(r["grams"])))
                if not asked:
                    continue
                counts, level = answered(shard if at == number else None, *(np.concatenate([x[k] for x in asked]) for k in (1, 2)))
                ends = [np.cumsum([len(x[k]) for x in asked])[:-1] for k in (1, 2)]
                counts, level = np.split(counts.astype("<i8"), ends[0]), np.split(level.astype(np.uint8), ends[1])
                out += [(x[0], number, c.tobytes(), v.tobytes()) for x, c, v in zip(asked, counts, level, strict=True)]
            if out:
                types = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names=["batch", "shard", "counts", "levels"])

    def finish(batches):
        import numpy as np
        import pyarrow as pa

        text, counts, level = None, [], []

        def close():
            asked = Asked(model.value, texts_of(text["sizes"], text["raws"]))
            c, v = np.frombuffer(b"".join(counts), "<i8"), np.frombuffer(b"".join(level), np.uint8).astype(np.int64)
            return result(pa.array(text["doc_ids"], pa.int64()), pa.array(text["held"], pa.bool_()), asked, c, v)

        for b in batches:
            for r in b.to_pylist():
                if r["shard"] < 0:
                    if text:
                        yield close()
                    text, counts, level = r, [], []
                else:
                    counts.append(r["counts"])
                    level.append(r["levels"])
        if text:
            yield close()

    first = F.lit(-1).cast("bigint")
    asked = texts.select("batch", "sizes", "raws").mapInArrow(ask, "shard bigint, batch bigint, words binary, grams binary")
    sent = shards.select("shard", first.alias("batch"), "words", "counts", "bits").unionByName(asked, allowMissingColumns=True)
    answers = sent.repartition("shard").sortWithinPartitions("shard", "batch").mapInArrow(probe, "batch bigint, shard bigint, counts binary, levels binary")
    back = texts.withColumn("shard", first).unionByName(answers, allowMissingColumns=True)
    return back.repartition("batch").sortWithinPartitions("batch", "shard").mapInArrow(finish, RESULT)


def score(docs: DataFrame, broadcast: int = BROADCAST, **limits) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    Null and empty texts have the end token alone. A null id counts as the empty text in the held-out rule. With no
    training row, all counts are 0. Repeated rows count as often as they stand and get equal rows; an empty table gives
    none; other columns are not read. ``broadcast`` bounds the bytes of a model that workers hold whole.
    """
    small_batches(docs.sparkSession)
    model, shards = train(docs, **limits)
    size = shards.agg(F.sum(F.octet_length("words") + F.octet_length("counts") + F.octet_length("bits"))).first()[0] or 0
    way = by_broadcast if size <= broadcast else by_exchange
    return way(plain_documents(docs), docs.sparkSession.sparkContext.broadcast(model), shards)


def op10_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
