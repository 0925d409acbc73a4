import hashlib
import random
import re
import time

from tabulon.llm import secrets as s

RULES = {
    "assign": re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}


def brute(text):
    out = []
    for k, (kind, rule) in enumerate(RULES.items()):
        for m in rule.finditer(text or ""):
            if len(m[2]) >= 8 if kind == "assign" else len(m[0]) >= (16 if kind == "access" else 32):
                out.append((m.start(), k, kind, m.end()))
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out)]


def literals(text):
    return [text[x["start"] : x["end"]] for x in s.spans(text) if x["kind"] == "literal"]


def test_base_matches_the_rules():
    rng, parts = random.Random(1), ["password", "PassWD", " ", "=", ":", '"', "'", "api_key", "APIKEY", "token=", "AKIA", "ABCDEFGH1234", "deadbeef", "0123456789abcdef", "xyz", "é", "\n", "ſecret", "toKen: "]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert [f"{x['kind']}:{x['start']}:{x['end']}" for x in s.spans(text) if x["base"]] == brute(text)


def test_lexing_names_constants_and_syntax():
    assert literals('db_pass = "Tr0ub4dor&3xyz"\nname = "Tr0ub4dor&3xyz"') == ["Tr0ub4dor&3xyz"]
    assert literals("K = 'aZ9$kLmQ2wEr'\nother = 'plain words'\nclient_auth_key = K\n") == ["aZ9$kLmQ2wEr"]
    assert literals('A = "aZ9$kLmQ2wEr"\nB = A\nconfig["signing_key"] = B') == ["aZ9$kLmQ2wEr"]
    assert literals('signingKey: "aZ9$k" + "LmQ2wEr7"') == ["aZ9$k", "LmQ2wEr7"]
    assert literals("<privateKey>aZ9$kLmQ2wEr</privateKey>") == ["aZ9$kLmQ2wEr"]
    assert literals("export ACCESS_PWD=aZ9$kLmQ2wEr") == ["aZ9$kLmQ2wEr"]
    assert literals('password = "changeme"; title = "aZ9$kLmQ2wEr"; keyboard = "aZ9$kLmQ2wEr"') == []
    assert literals("The key: it is here. A token of love = thanks") == []


KEY = "aZ9$kLmQ2wEr"


def test_lexing_by_syntax():
    assert literals(f"private_key = `{KEY}`") == [KEY]
    assert literals(f"signing_key: |\n  {KEY}\n  bY8kLmQ2wEr7\nnext: {KEY}") == [KEY, "bY8kLmQ2wEr7"]
    assert literals(f'client.setSigningKey("{KEY}")') == [KEY]
    assert literals(f"signing_key = K\nK = '{KEY}'") == [KEY]
    assert literals(f"function a() {{ K = '{KEY}' }}\nfunction b() {{ signing_key = K }}") == []
    assert literals(f"K = 'nothing'\nfunction a() {{ K = '{KEY}'; signing_key = K }}") == [KEY]
    assert literals(f'<add key="SigningKey" value="{KEY}"/><add key="title" value="{KEY}"/>') == [KEY]
    assert literals(f"signing_key: str = (\n  'aZ9$k'\n  'LmQ2wEr7'\n)") == ["aZ9$k", "LmQ2wEr7"]
    assert literals(f"# signing_key = '{KEY}'\nK = 1") == [KEY] and literals(f"# K = '{KEY}'\nsigning_key = K") == []
    assert literals(f'url = "host=a;signing_key={KEY}"') == [KEY]
    assert literals(f"it isn't signing_key = '{KEY}'") == [KEY]
    assert literals(f"signing_key = load('{KEY}')") == [] and literals(f"signing_key == '{KEY}'") == []
    assert literals('"signing_key": null, "auth": {"bearer_token_x": "short"}') == []


def programs(rng):
    """Text made of statements of known meaning, and the literals that must be found, as their texts."""
    out, want, n = [], [], 0

    def literal():
        nonlocal n
        n += 1
        return f"q{n}Zk$9wLm{n * 7919 % 9973}"

    def statement(name, sensitive):
        value, constant = literal(), f"c{rng.randrange(10**6)}x{n}"
        kind = rng.randrange(9)
        if sensitive:
            want.append(value)
        return [
            f'{name} = "{value}"',
            f"{name}: '{value}'",
            f'"{name}": "{value}",',
            f"{name} := `{value}`",
            f"{constant} = '{value}'\n{name} = {constant}",
            f"{name} = {constant}\n{constant} = '{value}'",
            f'{name}("{value}")',
            f"<{name}>{value}</{name}>",
            f"{name}: |\n    {value}\nend: 1",
        ][kind]

    for _ in range(rng.randint(1, 12)):
        sensitive = rng.random() < 0.5
        name = rng.choice(["signing_key", "dbPassphrase", "x.private_key", "CREDENTIAL"] if sensitive else ["title", "colour", "keyboard", "x.size", "MONKEY"])
        x = statement(name, sensitive)
        wrap = rng.randrange(5)
        if wrap == 0:
            x = f"/* {x} */" if "\n" not in x else x
        elif wrap == 1:
            x = f"f() {{\n{x}\n}}"
        elif wrap == 2:
            x = f"some words, don't mind.\n{x}"
        out.append(x)
    return "\n".join(out) + "\n", want


def test_lexing_of_made_programs():
    rng = random.Random(8)
    for _ in range(2000):
        text, want = programs(rng)
        assert sorted(literals(text)) == sorted(want), text


def test_long_runs_take_linear_time():
    began = time.time()
    for text in ("a" * 300_000, "a=" * 100_000, '"' * 100_000, 'x = "a"' + " " * 200_000, "<a>" * 60_000, "password" * 30_000, "abc123" * 50_000, "token" + " " * 200_000, "{" * 100_000 + "key = a;" * 100, "key: |\n" * 50_000, "`key " * 60_000, "/* key " * 40_000, '"""key ' * 40_000, "<!-- key " * 40_000, "(" * 100_000 + "key", "key('" * 40_000, "key = K\n" * 40_000, "'key' " * 50_000):
        s.spans(text)
    assert time.time() - began < 30


def test_scan_rows(spark):
    rows = [(1, None, "x", 1), (1, None, "x", 1), (2, "", "y", 2), (3, "é token: abcdefgh12", "z", 3), (None, "a" * 100_000, "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string, start int")
    got = {r.doc_id: r.spans for r in s.scan(docs).collect()}
    assert s.scan(docs).count() == 5 and got[1] == [] and got[2] == []
    assert [tuple(x) for x in got[3]] == [("assign", 2, 19, True)] and [x.kind for x in got[None]] == ["hex"]
    assert s.scan(docs.limit(0)).count() == 0


def test_query(spark):
    import duckdb

    from tabulon.llm.queries import QUERIES

    texts = dict(duckdb.execute("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall())
    got = QUERIES["op8_secrets"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k + ":") for x in want) for k in RULES)
        assert set(want) <= set(r.spans.split(",") if r.spans else [])
