"""License rules on whole and broken sequences."""

from pyspark.sql import functions as F

from colloquy.llm import license_rules as L

RULE = {n: r for n, r in L.RULES if not r[0].startswith("SPDX") and len(r) > 1}
BSD2, BSD3, MIT, ISC = ("\n\n".join(RULE[n]) for n in ("BSD-2-Clause", "BSD-3-Clause", "MIT", "ISC"))
MPL = RULE["MPL-2.0"]
ACME = BSD3.replace("the copyright holder nor", "Acme Inc. nor").replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "ACME INC.").replace("THE COPYRIGHT HOLDER OR CONTRIBUTORS", "ACME INC.")
#: As a comment of code, wrapped after so many characters.
def comment(text, width=60):
    out = []
    for paragraph in text.split("\n\n"):
        line = ""
        for word in paragraph.split(" "):
            if len(line) + len(word) > width:
                out.append(f" * {line}")
                line = ""
            line += f"{word} "
        out += [f" * {line}".rstrip(), " *"]
    return "/*\n" + "\n".join(out) + "/\ncode();"


ROWS = [
    (1, "Prose here. licensed UNDER the  apache license, version 2.0! More", "Apache-2.0"),
    (2, BSD3, "BSD-3-Clause"),
    (3, RULE["MIT"][1] + "\n" + RULE["MIT"][0], ""),
    (4, MIT, "MIT"),
    (5, None, ""),
    (6, "", ""),
    (7, "A license is a license. Permission was not granted.", ""),
    (8, "Été.\r\nReleased under the MIT License.\r\n" + "x " * 100000 + ". Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0,MIT"),
    (8, "Été.\r\nReleased under the MIT License.\r\n" + "x " * 100000 + ". Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0,MIT"),
    (None, MPL[0], ""),
    (10, " ".join(MPL), "MPL-2.0"),
    (11, "Software released, unencumbered, into the public\tdomain. This is free and unencumbered software released into the public\tdomain.", "Unlicense"),
    (12, BSD2, "BSD-2-Clause"),
    (13, ACME, "BSD-3-Clause"),
    (14, comment(ACME), "BSD-3-Clause"),
    (15, comment(MIT), "MIT"),
    (16, comment(ISC), "ISC"),
    (17, comment(BSD2) + "\n" + comment(BSD3), "BSD-2-Clause,BSD-3-Clause"),
    (18, "MIT License\n" + RULE["MIT"][0].replace(" copy, ", "\ncopy, ") + " " + RULE["MIT"][1], "MIT"),
    (19, "\n".join([MPL[0], *(f"line {i} of other text" for i in range(9)), MPL[1]]), ""),
    (20, "\n".join([MPL[0], "one line of other text", MPL[1]]), "MPL-2.0"),
    (21, "# SPDX-License-Identifier: GPL-2.0-or-later\n\n" + MIT, "GPL-2.0,MIT"),
    (22, RULE["MIT-0"][0], "MIT-0"),
    (23, "1) " + RULE["BSD-2-Clause"][1], ""),
]


def test_rules(spark):
    docs = spark.createDataFrame([r[:2] for r in ROWS], "doc_id long, text string").withColumn("licenses", F.lit("clash")).withColumn("_text", F.lit("own"))
    got = L.recognised(docs, keep=("doc_id", "licenses", "_text")).collect()
    assert sorted((str(r.doc_id), r.licenses) for r in got) == sorted((str(i), w) for i, _, w in ROWS)
    assert {r._text for r in got} == {"own"}


def test_oracle(spark, tmp_path):
    """The SQL oracle gives the same rows as the operator on these texts."""
    import duckdb

    docs = spark.createDataFrame([r[:2] for r in ROWS], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, L.recognised(docs).collect()), key=key) == sorted(con.sql(L.ORACLE).fetchall(), key=key)


def test_every_rule(spark):
    docs = spark.createDataFrame([(i, "Text before. " + "\n\n".join(r) + "\n\nText behind.") for i, (_, r) in enumerate(L.RULES)], "doc_id long, text string")
    for r in L.recognised(docs).collect():
        assert r.licenses == L.RULES[r.doc_id][0]


def test_empty(spark):
    assert L.recognised(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_both_cuttings(spark):
    """Known lines and known sentences over several lines are both recognised in one text."""
    wrap = lambda x: x.replace(" use ", "\nuse ").replace(" copy ", "\ncopy ")
    spdx = "SPDX-License-Identifier: MIT\nmore text\n\n"
    apache = "\n\n".join(RULE["Apache-2.0"])
    texts = [spdx + wrap(apache), spdx + spdx + ISC.replace(", ", ",\n"), f"{RULE['MIT'][0]}\n{'x' * 5}\n\n{wrap(RULE['MIT'][1]).replace(' and this', chr(10) + 'and this')}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.licenses for r in L.recognised(docs).collect()} == {0: "Apache-2.0,MIT", 1: "ISC,MIT", 2: "MIT"}
