"""Line frequency of the quality rules against plain Python: every row is a document, copies and repeated rows too."""

import random
import re
from collections import Counter

from maskwell.llm import quality_rules


def plain(rows, limit, share):
    normal = lambda x: re.sub("[0-9]", "0", re.sub("[ \t-\r]+", " ", x.lower())).strip(" ")
    lines = [[normal(x) for x in (t or "").split("\n") if x.strip(" \t\n\v\f\r")] for _, t, _ in rows]
    found = Counter((h, x) for (_, _, h), xs in zip(rows, lines) for x in set(xs))
    out = []
    for (k, t, h), xs in zip(rows, lines):
        words = len(re.findall(r"[^ \t-\r]+", t or ""))
        gone = sum(len(x.split(" ")) for x in xs if found[h, x] > limit)
        out.append((k, words, gone, words - gone >= share * words))
    return sorted(out, key=repr)


def test_lines_above_the_limit_are_removed(spark):
    rng = random.Random(6)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6):x}q" for _ in range(n))
    rows = [(k, f"{fresh(30)}\nAll  rights reserved {k}{k % 7}\n\n{fresh(9)}", "ab"[k % 2]) for k in range(10, 30)]
    rows += [(100 + k, "one text with copies " + "of some length " * 8, "a") for k in range(5)]
    rows += [(200, "twice\ntwice\n" + fresh(25), "c"), (200, "twice\ntwice\n" + rows[0][1], "c"), (None, None, None), (300, "", "a"), (301, fresh(40), None), (302, " \t\n", "b")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, h int").repartition(4)
    for limit in (1, 3, 4, 5, 9, 10):
        got = quality_rules.judge(docs, max_documents=limit).collect()
        assert sorted(((r.doc_id, r.n_words, r.removed_words, r.n_words - r.removed_words >= 0.5 * r.n_words) for r in got), key=repr) == plain(rows, limit, 0.5)
        assert all(r.kept == (not r.base_failed and r.n_words - r.removed_words >= 0.5 * r.n_words) for r in got)
    assert quality_rules.judge(docs.limit(0)).count() == 0
