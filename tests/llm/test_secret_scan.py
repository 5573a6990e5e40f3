from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

from llm_cases import EDGE
from lossloom.llm import secret_scan as S

KEYWORD = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""(?:{KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    text = text or ""
    found = [[(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6],
             [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20],
             [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]]
    joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(sum(found, [])))
    return (*map(len, found), hashlib.sha256(joined.encode()).hexdigest(), joined)


def made(n):
    rng = random.Random(9)
    bits = ["password", "PassWd", "sEcret=", "token: ", "api_key", "APIKEY = '", "\"", "'", " ", "  ", ":", "=", "abc", "abcdef", "AKIA", "ABCDEFGHIJKLMNOP", "deadbeef" * 3,
            "0123456789abcdef01234567", "é𝔘", "ſecret=", "toKen=abcdefg", "\n", "token=secret=x", "secret=token: abcdefgh"]
    return [(1000 + i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for i in range(n)]


def table(docs, rows):
    return S.ratio_table(S.labelled_samples(docs(rows)))


def test_base_spans_match_brute_force(docs, corpus):
    rows = [(r[0], r[1]) for r in corpus] + made(300) + EDGE
    out = S.scan(docs(rows), table(docs, rows)).collect()
    got = Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"], ",".join(x for x in r["spans"].split(",") if x and not x.startswith("random"))) for r in out)
    assert got == Counter((k, *base(t)) for k, t in rows)


def test_models_tell_random_from_ordinary(docs, corpus):
    t = table(docs, [(r[0], r[1]) for r in corpus])
    rng = random.Random(1)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    secrets = ["".join(rng.choice(letters) for _ in range(40)) for _ in range(60)]
    words = sorted({w.strip(".,") for r in corpus for w in (r[1] or "").lower().split() if w.strip(".,").isascii() and w.strip(".,").isalpha()})
    plain = ["_".join(rng.choice(words) for _ in range(6)) for _ in range(60)]
    out = {r["doc_id"]: r for r in S.scan(docs([(i, f"x {s}, y") for i, s in enumerate(secrets + plain)]), t).collect()}
    assert sum(out[i]["n_random"] for i in range(60)) >= 57 and sum(out[i]["n_random"] for i in range(60, 120)) <= 3
    assert all(out[i]["spans"] == "random:2:42" for i in range(60) if out[i]["n_random"])


def test_clean_numbers_paths_and_rulers_are_ordinary(docs, corpus):
    t = table(docs, [(r[0], r[1]) for r in corpus])
    rng = random.Random(3)
    clean = ["=" * 20, "=" * 60, "-" * 40, "_" * 30, "a" * 40, "x" * 200, "+----------+--------+-----+", "=-" * 20, "com/example/project/module/ClassName",
             "20240101123045123456", "1234567890123456789012", "0" * 20, "2024-01-01T12-30-45-123456", "production_database_connection_key", "page=2/user_id=123456789",
             "AbstractSingletonProxyFactoryBean", "MAX_CONNECTION_POOL_SIZE_DEFAULT", "/usr/local/lib/python3/site-packages/numpy/core"]
    clean += [str(rng.randrange(10**19, 10**23)) for _ in range(40)]
    out = S.scan(docs([(i, f"x {s}, y") for i, s in enumerate(clean)]), t).collect()
    assert [clean[r["doc_id"]] for r in out if r["n_random"]] == []


def test_secrets_are_found_behind_names_paths_and_base_spans(docs, corpus):
    t = table(docs, [(r[0], r[1]) for r in corpus])
    rng = random.Random(7)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = "token=abcdefgh, "
    rows = []
    for before, after in (("production_database_connection_key=", ""), ("config/production/service/", "/public/index"), ("deadbeef" * 4 + "/", ""), (key + "x ", "")):
        rows += [(before, "".join(rng.choice(letters) for _ in range(n)), after) for n in (16, 20, 24, 32, 40) for _ in range(8)]
    out = {r["doc_id"]: r["spans"] for r in S.scan(docs([(i, b + s + a) for i, (b, s, a) in enumerate(rows)]), t).collect()}
    found = near = 0
    for i, (before, secret, _) in enumerate(rows):
        spans = [tuple(map(int, x.split(":")[1:])) for x in out[i].split(",") if x.startswith("random")]
        a, b = len(before), len(before) + len(secret)
        found += any(min(y, b) - max(x, a) >= 0.8 * (b - a) for x, y in spans)
        near += any(abs(x - a) <= 3 and abs(y - b) <= 3 for x, y in spans)
    assert found >= 0.97 * len(rows) and near >= 0.85 * len(rows), (found, near, len(rows))
    two = "first_key=" + "q7Zt0XbW9rLkV3mP" + "/some/ordinary/directory/second_key=" + "Hn4Yc8JdS1gQfU6e"
    spans = S.scan(docs([(1, two)]), t).collect()[0]["spans"]
    assert spans.count("random") == 2, spans


def test_plan_has_no_python_and_no_rows_give_none(docs):
    t = table(docs, [])
    df = S.scan(docs([]), t)
    assert df.collect() == []
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEval" not in plan and "MapIn" not in plan and "BatchEval" not in plan
