"""Pseudonyms: formats, permutations and a plain version of the network."""

import datetime
import hashlib
import re

from pyspark.sql import functions as F

from colloquy.llm import private_values as V

KEY = "test's key"


def luhn(s):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c)) for i, c in enumerate(reversed(s))) % 10 == 0


def shift(kind, i, half):
    return int(hashlib.sha256(f"{KEY}|{kind}|{i}|{half}".encode()).hexdigest()[:12], 16)


def feistel(kind, l, r, a, b):
    for i in range(1, V.ROUNDS + 1):
        if i % 2:
            l = (l + shift(kind, i, r)) % a
        else:
            r = (r + shift(kind, i, l)) % b
    return l, r


def digits(kind, s):
    h = len(s) // 2
    l, r = feistel(kind, int(s[:h]), int(s[h:]), 10**h, 10 ** (len(s) - h))
    return f"{l:0{h}d}{r:0{len(s) - h}d}"


def fill(template, s):
    s = iter(s)
    return "".join(next(s) if c.isdigit() else c for c in template)


def plain(m):
    hash_ = hashlib.sha512(f"{KEY}|text|{m}".encode()).hexdigest()
    d = re.sub(r"\D", "", m)
    if "@" in m:
        return f"user-{hash_[:32]}@mail.invalid"
    if re.fullmatch("[0-9a-f]{32,}|[0-9A-F]{32,}", m) and re.search("[A-Fa-f]", m):
        blocks = [hash_] + [hashlib.sha512(f"{KEY}|text|{i}|{m}".encode()).hexdigest() for i in range(2, len(m) // 128 + 2)]
        whole = "".join(blocks)[: len(m)]
        return whole.upper() if re.search("[A-F]", m) else whole
    if m.count(".") == 3:
        o = list(map(int, m.split(".")))
        l, r = feistel("address", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        return f"{l // 256}.{l % 256}.{r // 256}.{r % 256}"
    for form in ("%Y-%m-%d", "%d/%m/%Y"):
        try:
            n = (datetime.datetime.strptime(m, form).date() - datetime.date(1900, 1, 1)).days
        except ValueError:
            continue
        l, r = feistel("date", n // 229, n % 229, 319, 229)
        return (datetime.date(1900, 1, 1) + datetime.timedelta(l * 229 + r)).strftime(form)
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", m):
        a, g, s = map(int, m.split("-"))
        if not (0 < a < 900 and a != 666 and g and s):
            return m
        l, r = feistel("social", (a - 1 - (a > 666)) * 99 + g - 1, s - 1, 898 * 99, 9999)
        a = l // 99 + 1
        return f"{a + (a >= 666):03d}-{l % 99 + 1:02d}-{r + 1:04d}"
    if m[0] in "+(":
        c = len(re.match(r"\+(\d{1,3})", m)[1]) if m[0] == "+" else 0
        return fill(m, d[:c] + digits("phone", d[c:]))
    if luhn(d):
        b = digits("account", d[:-1])
        return fill(m, b + next(x for x in "0123456789" if luhn(b + x)))
    return m


VALUES = ["und.34@mail7.example.com", "UND.34@MAIL7.EXAMPLE.COM", "04dbebab91ab85687d33eeaaf9ac699e1188f962", "97.51.17.173",
          "1999-02-28", "1999-02-30", "28/02/1999", "123-45-6789", "666-45-6789", "899-99-9999", "+1 (017) 555-7713", "(555) 123-4567",
          "4111111111111111", "4111111111111112", "4111 1111 1111 1111", "+49 30 123 4567", "256.1.1.1", "1.2.3.4.5", "12345", "v1.2.3",
          "04DBEBAB91AB85687D33EEAAF9AC699E1188F962", "first.last" * 7 + "@" + "sub-domain" * 7 + ".example.com", "04dbebab" * 18,
          "bob@example.com.5", "bob@example.com.5.6", "pkg@1.2.3", "me@home...ok"]


def test_values(spark):
    rows = [(i, f"Call é {v}, or \"{v}\"!! {v}###\nx{v}y {v}") for i, v in enumerate(VALUES)]
    rows += [(100, None), (101, ""), (102, "no values"), (103, "4111111111111111 and 97.51.17.173 " * 3000), (None, VALUES[0]), (None, VALUES[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_private", F.lit("clash"))
    got = V.pseudonymised(docs, KEY).collect()
    assert len(got) == len(rows)
    pattern = re.compile(V.PATTERN)
    want = sorted((str(i), t and pattern.sub(lambda m: plain(m[0]), t)) for i, t in rows if t is not None)
    assert sorted((str(r.doc_id), r.text) for r in got if r.text is not None) == want
    by = {r.doc_id: r for r in got}
    for i, v in enumerate(VALUES):
        hidden = v not in ("1999-02-30", "666-45-6789", "4111111111111112", "256.1.1.1", "1.2.3.4.5", "12345", "v1.2.3", "pkg@1.2.3", "me@home...ok")
        assert (f" {v}, or" not in by[i].text) == hidden == (by[i].n_private > 0), v
    assert by[100].text is None and by[102].n_private == 0 and by[103].n_private == 6000
    assert all(luhn(re.sub(r"\D", "", x)) for x in re.findall(r"(?<!\d)\d{16}(?!\d)", by[103].text))


def test_permutation(spark):
    docs = spark.range(20000).selectExpr("id as doc_id", "concat(lpad(id, 10, '0'), '') x").selectExpr("doc_id", "concat('+1 (', left(x, 3), ') ', substr(x, 4, 3), '-', right(x, 4)) text")
    got = V.pseudonymised(docs, KEY)
    assert got.select("text").distinct().count() == 20000
    assert got.where("not text rlike '^\\\\+1 \\\\([0-9]{3}\\\\) [0-9]{3}-[0-9]{4}$'").count() == 0


def test_empty(spark):
    assert V.pseudonymised(spark.createDataFrame([], "doc_id long, text string"), KEY).count() == 0


def test_long_runs(spark):
    """Runs that look like the beginning of a value are read in time in proportion to their length."""
    rows = [(1, "a." * 200000), (2, "x@" + "a." * 200000), (3, "a@" * 100000), (4, "f" * 400000 + "g"), (5, "1.2" * 100000), (6, "x@" + "1." * 200000 + "com")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_private for r in V.pseudonymised(docs, KEY).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 1}


def test_clashes(spark):
    """Columns with the names used on the way come back unchanged, and the key is in no plan."""
    docs = spark.createDataFrame([(1, "on 1999-02-28", "a", "b", "c", "d")], "doc_id long, text string, _found string, _names string, _key string, __found string")
    done = V.pseudonymised(docs, "very secret key")
    row = done.first()
    assert row[2:] == ("a", "b", "c", "d", 1) and row.text != "on 1999-02-28"
    assert "very secret" not in done._jdf.queryExecution().toString()


def test_query(spark):
    """The registered query against the plain version, on the whole table."""
    from colloquy.llm.queries import QUERIES

    global KEY
    before, KEY = KEY, "change this key"
    try:
        name, pattern = "/root/testdata/sf0.001", re.compile(V.PATTERN)
        want = {r.doc_id: r.text and pattern.sub(lambda m: plain(m[0]), r.text) for r in spark.read.parquet(f"{name}/documents.parquet").collect()}
        assert {r.doc_id: r.text for r in QUERIES["op9_private_values"](spark, name).collect()} == want
    finally:
        KEY = before
