import hashlib
import random
import re

import pytest

from tidewatch.llm import contracts, secret_scan

BASE = {
    "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": ("AKIA[A-Z0-9]+", 0, 16),
    "hex": ("[0-9a-f]+", 0, 32),
}


def base_spans(text):
    """Every match of the plain patterns, failing ones dropped afterwards."""
    found = []
    for n, (kind, (pattern, group, least)) in enumerate(BASE.items()):
        found += [(m.start(), n, kind, m.end()) for m in re.finditer(pattern, text or "") if len(m.group(group)) >= least]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def added(text):
    return [(s[0], text[s[1] : s[2]], s[3]) for s in secret_scan.scan(text) if s[0] in ("literal", "constant")]


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ('db_pwd = "tr0ub4dor&3"', [("literal", "tr0ub4dor&3", "db_pwd")]),
        ('const passphrase: String = "k9-Zebra-41";', [("literal", "k9-Zebra-41", "passphrase")]),
        ('{"client": {"credentials": "u7Qp 99xa"}}', [("literal", "u7Qp 99xa", "credentials")]),
        ('config["db_pwd"] = "a1b2c3d4"', [("literal", "a1b2c3d4", "db_pwd")]),
        ("export DB_PASS=x81kq0zz41", [("literal", "x81kq0zz41", "DB_PASS")]),
        ("auth:\n  passphrase: 77horse-Staple", [("literal", "77horse-Staple", "passphrase")]),
        ("mysql --db-pass zk1!77pqr -h host", [("literal", "zk1!77pqr", "db-pass")]),
        ("<dbPwd>q8Wn41xx</dbPwd>", [("literal", "q8Wn41xx", "dbPwd")]),
        ('client.setPassphrase("m4rble-Run")', [("literal", "m4rble-Run", "Passphrase")]),
        ('headers.put("X-Auth", "Zx81-Spectrum-48k")', [("literal", "Zx81-Spectrum-48k", "X-Auth")]),
        # Constants flow along names and concatenations.
        ('part = "x9Kq"\nwhole = part + "77Lm!"\npassword = whole', [("constant", "x9Kq", "password"), ("constant", "77Lm!", "password")]),
        ('A = "s3cr3t-v4lue"\nB = A\nC = B\nopen(password=C)', [("constant", "s3cr3t-v4lue", "password")]),
        ('base = "Zq81ma"\ndb_pwd = f"{base}-91"', [("constant", "Zq81ma", "db_pwd"), ("literal", "{base}-91", "db_pwd")]),
        # The latest assignment counts.
        ('a = "s3cr3t-v4lue"\na = "0ther-v4lue"\npassword = a', [("constant", "0ther-v4lue", "password")]),
    ],
)
def test_names_and_constants(text, wanted):
    assert added(text) == wanted


@pytest.mark.parametrize(
    "text",
    [
        'title = "A plain title 2024"', 'db_pwd = "changeme"', 'password_length = "12345678"', 'auth_url = "http://host8.example/x1"', "Auth: please sign in at the door",
        'pwd = os.getenv("DB_PWD_9")', 'pwd = "${UNKNOWN}"', "The key: it was raining", "pass = ******", "", "\n\n", "= = : :", '"', "pwd =", '"pwd":', 'x = x + x\ndb_pwd = y',
    ],
)
def test_nothing_to_add(text):
    assert added(text) == []


def test_chains_grow_with_the_text_alone():
    text = 'v0 = "x9Kq77Lm"\n' + "".join(f"v{i + 1} = v{i} + v{i}\n" for i in range(3000)) + "db_pwd = v3000\n" * 300
    assert added(text) == [("constant", "x9Kq77Lm", "db_pwd")]


def _texts():
    rng = random.Random(4)
    parts = ["password", "PassWd", "secret", "ToKen", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "AKIAABCDEFGH1234", "0123456789abcdef" * 2, "deadbeef", "x", "abcdefgh", "é", "ſecret", "toKen", "\n", "token = ", "😀", "--pwd ", "db_pwd = "]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(1500)]


def test_base_spans_equal_plain_patterns():
    for text in [*_texts(), "password = secret: abcdefgh1", "a" * 31 + "g" + "b" * 32, "AKIAAKIAX" + "B" * 20]:
        assert [s[:3] for s in secret_scan.scan(text) if s[0] in BASE] == base_spans(text)


def test_query_equals_brute_force(spark, tmp_path):
    rows = [(i, t, "s", i) for i, t in enumerate(_texts()[:200])]
    rows += [(None, "password=abcdefgh", "s", 1), (7, None, "s", 1), (8, "", None, None), (9, 'db_pwd = "a1b2c3d4"', "s", 1), (9, 'db_pwd = "a1b2c3d4"', "s", 1), (10, "word " * 200_000 + "token=abcdefgh12", "s", 1)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, spans string, n_hex long").repartition(5).write.parquet(path)
    out = contracts.op11_secret_scan(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    by_key = {}
    for doc_id, text, *_ in rows:
        by_key.setdefault(doc_id, []).append(base_spans(text))
    for r in out:
        options = [
            (*(sum(s[0] == k for s in spans) for k in BASE), hashlib.sha256(",".join("%s:%d:%d" % s for s in spans).encode()).hexdigest())
            for spans in by_key[r.doc_id]
        ]
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) in options
        assert all(s in r.spans.split(",") for spans in by_key[r.doc_id] if len(by_key[r.doc_id]) == 1 for s in ("%s:%d:%d" % x for x in spans))
    added = [r.spans for r in out if r.doc_id == 9 and r.n_added]
    assert added == ["literal:10:18"] * 2
    assert [r.spans for r in out if r.doc_id == 8 and r.n_added == 0 and r.base_sha256 == hashlib.sha256(b"").hexdigest() and r.spans == ""]


def test_empty_table(spark):
    assert secret_scan.find_secrets(spark.createDataFrame([], "doc_id long, text string")).collect() == []
