import random
import re
import unicodedata

from maskwell.llm import toxicity

SUBSTITUTED = re.compile(r"[^\W\d_]*(?:[0134578@$!]+[^\W\d_]+)+(?:[0134578@$]{1,2}(?!\w))?|[^\W\d_]+[0134578@$]{2}(?!\w)")


def stated(text):
    """Folding step by step over the whole text."""
    text = unicodedata.normalize("NFKD", text.lower())
    text = toxicity.UNSEEN.sub("", text).lower().translate(toxicity.FOLD)
    text = SUBSTITUTED.sub(lambda m: m[0].translate(toxicity.STANDS_FOR), text)
    return " " + re.sub(r"[\W_]+", " ", re.sub(r"(?<=[^\W\d_])(?=\d)", " ", text)).strip() + " "


def test_folding_equals_the_steps():
    rng = random.Random(1)
    letters = "abAZ019@$!_ -.\n\tİıßΣσς𝚺áé́​ﬁ①²½жЖюøł５Ａ中७%"
    texts = ["", " ", "a1b2", "1d10t a55 trash3 a$$", "𝓲𝓭𝓲𝓸𝓽", "ИДИОТ", "a𝚺 𝚺a", "x" * 500, "ж" * 500, "a1" * 500]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(14))) for _ in range(50_000)]
    assert [t for t in texts if toxicity.folded(t) != stated(t)] == []
    assert len(toxicity.PLAINER) <= toxicity.Plainer.MOST
    for long in ("x" * 1_000_000, "ж" * 1_000_000, "a1" * 500_000):  # in one pass, not in one from each letter
        assert len(toxicity.folded(long)) >= 1_000_000
