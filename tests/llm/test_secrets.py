import hashlib
import random
import re
import string

from tallyloom.llm import secrets as S

KINDS = {
    "assign": re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}


def brute(text):
    out = []
    for kind, p in KINDS.items():
        for m in p.finditer(text):
            size = len(m[2]) if kind == "assign" else len(m[0])
            if size >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda x: (x[0], S.KINDS.index(x[2])))


def noise(rng):
    parts = ["password", "passWD", "api_key", "APIKEY", "secret", "token", '"', "'", " ", "  ", ":", "=", "AKIA", "AKIAKIA", "ABCDEFGHIJ0123456789", "deadbeef", "0123456789abcdef", "é", "İ", "K", "x", "g", "\n", "abcdefabcdefabcdefabcdef"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))


def test_base_spans_equal_brute_force():
    rng = random.Random(3)
    for _ in range(6000):
        t = noise(rng)
        assert [x for x in S.scan(t) if x[2] in S.BASE] == brute(t), t
        t = "".join(rng.choice("0123456789abcdefg") if rng.random() < 0.97 else " " for _ in range(rng.randint(0, 200)))
        assert [x for x in S.scan(t) if x[2] == "hex"] == [x for x in brute(t) if x[2] == "hex"], t


def test_checksums():
    body = "".join(random.Random(1).choice(string.ascii_letters) for _ in range(30))
    good = "ghp_" + body + S.crc62(body)
    assert S.scan(f"x {good} y") == [(2, 42, "github")]
    assert not S.scan("ghp_" + body + "000000")
    assert S.scan("npm_" + body + S.crc62(body)) == [(0, 40, "npm")]
    raw = b"\x80" + bytes(range(32))
    raw += hashlib.sha256(hashlib.sha256(raw).digest()).digest()[:4]
    n, key = int.from_bytes(raw, "big"), ""
    while n:
        n, d = divmod(n, 58)
        key = S.BASE58[d] + key
    assert S.scan(f"key {key}.") == [(4, 4 + len(key), "wif")]
    assert not S.scan(f"key {key[:-1]}{'1' if key[-1] != '1' else '2'}.")


def test_rows(spark):
    df = spark.createDataFrame(
        [(1, "token = abcdef1", "a"), (1, "token = abcdef1", "b"), (2, None, "c"), (None, "", "d"), (3, "z " * 40000 + "AKIA" + "Q" * 16, "e")],
        "doc_id bigint, text string, spans string",
    )
    got = sorted(map(tuple, S.secret_spans(df).collect()), key=str)
    empty = hashlib.sha256(b"").hexdigest()
    one = (1, 1, 0, 0, hashlib.sha256(b"assign:0:15").hexdigest(), "assign:0:15")
    long = (3, 0, 1, 0, hashlib.sha256(b"access:80000:80020").hexdigest(), "access:80000:80020")
    assert got == sorted([one, one, (2, 0, 0, 0, empty, ""), (None, 0, 0, 0, empty, ""), long], key=str)
    assert S.secret_spans(df.limit(0)).count() == 0
    assert S.redact(df).where("doc_id = 1").first().text == "[secret]"
