import base64
import gzip
import hashlib
import random
import re
import urllib.parse

from maskwell.llm import secrets

KEY = "password=hunter2hunter2"


def brute(text):
    """The base rules as literally as they are stated."""
    out = []
    at = 0
    rx = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    while m := rx.search(text, at):
        if len(m[2]) >= 6:
            out.append((m.start(), "assign", m.end()))
        at = m.end()
    for kind, pattern, least in (("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(out, key=lambda x: (x[0], ["assign", "access", "hex"].index(x[1])))


def test_base_matches_brute_force():
    rng = random.Random(1)
    bits = ["token", "TOKEN", "=", ": ", "token=", "abc", "abcdef12", "AKIA", "ABCDEFGH12345678", "0123456789abcdef" * 2, '"', "'", " ", "\n", "é", "ſecret=", "toKen=", "api_key=", "apikey :"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        assert secrets.base_spans(text) == brute(text), text


def spans(text):
    base, found, *_ = secrets.scan(text)
    return [text[a:b] for a, _, b in found if (a, _, b) not in base]


def test_layers_map_back():
    url = urllib.parse.quote(KEY, safe="")
    assert spans(f"see {url} here") == [url]
    escaped = "".join(f"\\u{ord(c):04x}" for c in KEY)
    assert spans(f"see {escaped} here") == [escaped]
    b64 = base64.b64encode(b"the " + KEY.encode()).decode()
    assert len(spans(f"é {b64} x")) == 1 and b64.endswith(spans(f"é {b64} x")[0])
    packed = base64.b64encode(gzip.compress(KEY.encode())).decode()
    assert spans(f"x {packed} y") == [packed]
    twice = base64.b64encode(base64.b64encode(gzip.compress(KEY.encode()))).decode()
    deep = urllib.parse.quote(urllib.parse.quote(twice, safe=""), safe="")
    assert spans(f"x {deep} y") and secrets.scan(deep)[3] >= 3
    two = f"{b64} and {b64}"
    assert len(spans(two)) == 2


def test_cycles_end():
    # %2525... loses one escape a layer; the last layer decodes to itself
    text = "%" + "25" * 40 + "41"
    assert secrets.scan(text)[2:4] == (41, 41)
    assert secrets.scan("QUJDREVGR0hJSktMTU5PUA==")[4] == 0


def test_bomb_is_cut():
    bomb = base64.b64encode(gzip.compress(b"a" * 100000)).decode()
    assert secrets.scan(bomb, limit=1000)[4] == 1


def test_documents(spark):
    texts = [None, "", KEY, "x " * 100000 + KEY, KEY, "nothing"]
    docs = spark.createDataFrame([(k, t, "clash", 5) for k, t in enumerate(texts)], "doc_id long, text string, spans string, n_chars long")
    got = {r.doc_id: r for r in secrets.find_secrets(docs).collect()}
    assert [got[k].n_assign for k in range(6)] == [0, 0, 1, 1, 1, 0]
    assert got[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[3].spans == f"assign:200000:{200000 + len(KEY)}"
    clean = {r.doc_id: r for r in secrets.without_secrets(docs).collect()}
    assert clean[2].text == "[SECRET]" and clean[2].n_chars == 8 and clean[2].spans == "clash"
    assert clean[0].text is None and clean[5].text == "nothing" and clean[5].n_chars == 5
    assert secrets.find_secrets(docs.limit(0)).count() == 0
