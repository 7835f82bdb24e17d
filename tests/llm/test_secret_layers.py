"""Secrets in layers that are easily passed over."""

import base64
import bz2
import gzip
import lzma
import random
import zlib

import pytest
import zstandard

from maskwell.llm import secrets

KEY = "password=hunter2hunter2"


def spans(text, **limits):
    base, found, *_ = secrets.scan(text, **limits)
    return [text[a:b] for a, _, b in found if (a, _, b) not in base]


def test_url_safe_tokens():
    # '-' and '_' come after 16 and more characters of both alphabets
    plain = base64.urlsafe_b64encode(b"a plain beginning >>>???" + KEY.encode()).decode()
    assert set("-_") & set(plain[16:]) and not set("-_") & set(plain[:16])
    assert len(spans(f"see {plain} here")) == 1
    rng = random.Random(2)
    for pack in (zlib.compress, gzip.compress, zstandard.ZstdCompressor().compress):
        noise = "".join(chr(rng.randrange(33, 127)) for _ in range(600))
        token = base64.urlsafe_b64encode(pack(f"{noise} {KEY}".encode())).decode()
        assert set("-_") & set(token)
        assert spans(f"see {token} here") == [token]


def test_tokens_beside_separators():
    token = base64.b64encode(b"the " + KEY.encode()).decode()
    for text in (f"my-name-{token}", f"a_b_{token}", f"see {token}-"):
        assert len(spans(text)) == 1, text


def test_escapes_beside_plain_text():
    for secret in (r'p\u0061ssword": "hunter2secret', "password%3A hunter2secret", r"p\x61sswd = hunter2secret", 'tok%65n" : "abcdef123456', r"api\u{5f}key='abcdef123456"):
        text = f'é {{"{secret}"}}'
        assert spans(text) == [secret], text
        assert secrets.scan(f"{text} and {text}")[1].__len__() == 2
    nested = "x password%253A hunter2secret y"
    assert spans(nested) == ["password%253A hunter2secret"]
    pair = r"\ud83d\ude00 \ud83d p\u0061ssword=hunter2secret"
    assert secrets.unicode_layer(pair)[0] == "\U0001f600 \ufffd password=hunter2secret"
    assert spans(pair) == [r"p\u0061ssword=hunter2secret"]
    # what the whole layer takes as a value is a name in the run
    assert "api_key%20=%20abcdefgh" in spans("token: api_key%20=%20abcdefgh")


def test_odd_bytes_beside_secrets():
    assert spans("x name=Ren%E9&password%3Dhunter2secret y") == ["password%3Dhunter2secret"]
    assert spans("x a=%00&token%3Dabcdef123456 y") == ["token%3Dabcdef123456"]
    assert spans("x %E9%C3%A9%F0%9F%98%80%FFp%61ssword%3Dhunter2secret y") == ["p%61ssword%3Dhunter2secret"]
    for odd in (b"\0", b"\xe9", b"\xf0\x9f", b"\xff" * 7, b"\xef\xbf\xbd\xed\xa0\x80"):
        for beyond in (b"", odd, b" and \xe9\0 more"):
            token = base64.b64encode(odd + KEY.encode() + beyond).decode()
            (found,) = spans(f"x {token} y")
            assert token.index(found) == len(odd) * 4 // 3 and abs(len(found.rstrip("=")) - len(KEY) * 4 / 3) < 2
    # an unreadable payload without a secret is no layer
    assert secrets.scan(base64.b64encode(bytes(range(200, 256))).decode())[2:] == (0, 0, 0)


def packers():
    z = zstandard.ZstdCompressor().compress
    return {"gzip": gzip.compress, "zlib": zlib.compress, "bz2": bz2.compress, "xz": lzma.compress, "zstd": z}


@pytest.mark.parametrize("name", ["gzip", "zlib", "bz2", "xz", "zstd"])
def test_all_members(name):
    pack = packers()[name]
    token = base64.b64encode(pack(b"nothing here ") + pack(b"nor here ") + pack(KEY.encode())).decode()
    assert spans(f"x {token} y") == [token]
    trailing = base64.b64encode(pack(b"nothing here") + b"\0\0\0\0" + KEY.encode()).decode()
    assert spans(f"x {trailing} y") == [trailing]
    split = pack(b"passwo") + pack(b"rd=hunter2hunter2")
    assert len(spans(base64.b64encode(split).decode())) == 1
    cut_off = pack(" ".join(map(str, range(3000))).encode() + KEY.encode())[:-9]
    secrets.scan(base64.b64encode(cut_off).decode())  # ends


@pytest.mark.parametrize("name", ["gzip", "zlib", "bz2", "xz", "zstd"])
def test_all_windows(name):
    pack, rng = packers()[name], random.Random(3)
    for n in [*range(900, 1100, 7), 5000, 100_000]:
        filler = "".join(rng.choice("ab ,é") for _ in range(n))
        secret = rng.choice([KEY, base64.b64encode(b"the " + KEY.encode()).decode(), "p%61ssword%3Dhunter2secret", base64.b64encode(gzip.compress(KEY.encode())).decode()])
        token = base64.b64encode(pack(f"{filler} {secret} {filler}".encode())).decode()
        assert spans(f"x {token} y", limit=1000) == [token], (n, secret)
        assert secrets.scan(token, limit=1000)[4] == 1
    # a run that is longer than a window
    run = base64.b64encode(b"word " * 2000 + KEY.encode()).decode()
    token = base64.b64encode(pack(run.encode())).decode()
    assert spans(f"x {token} y", limit=1000) == [token]


def test_plain_text_that_looks_compressed():
    for head in (b"x^ ", b"BZh9 ", b"x\x9c "):
        assert len(spans(base64.b64encode(head + KEY.encode()).decode())) == 1


def test_windows_hold_everything():
    rng = random.Random(4)
    for limit in (8, 50, 1000):
        data = "".join(rng.choice("ab é\U0001f600") for _ in range(5000))
        raw = data.encode()
        got = list(secrets.windows((raw[k : k + 7] for k in range(0, len(raw), 7)), limit))
        assert max(map(len, got)) <= limit + 7
        at = 0
        for text in got:
            at = data.index(text, max(0, at - len(text))) + len(text)
        assert at == len(data)
