import re

import duckdb
from pyspark.sql import functions as F

from pagemill.llm import licenses
from pagemill.llm.queries import op4_licenses, op4_sql

SF = "/root/testdata/sf0.001"


def test_whole_texts_only(spark):
    mit = dict(licenses.TEXTS)["MIT"]
    rows = [
        (1, "MIT Licence text?"), (2, "Copyright (c) 2020 Somebody\n\n" + mit.upper()), (3, " * " + re.sub(" ", "  \n", mit)), (4, mit + " more"), (5, None), (6, "..."), (7, "Copyright (c) 1999 X"),
        (None, mit), (8, "Released under the M.I.T. License"), (8, "released under the mit LICENCE!"), (9, mit.replace("sublicense", "sub-license").replace("AUTHORS OR COPYRIGHT HOLDERS", "authors or copyright owners")), (10, "word " * 30000),
    ]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, license_id_ string")
    for few in (100, 0):
        got = licenses.scan(docs, licenses.known(spark, [("Expat", mit)]), broadcast_rows=few).collect()
        found = sorted((r.doc_id or -1, r.license_id) for r in got if r.license_id)
        assert found == [(-1, "Expat OR MIT"), (2, "Expat OR MIT"), (3, "Expat OR MIT"), (8, "MIT-notice"), (9, "Expat OR MIT")]
        assert sorted(r.doc_id for r in got if r.license_digest is None) == [5, 6, 7] and len(got) == len(rows)
    assert licenses.scan(docs.limit(0), licenses.known(spark)).collect() == []


def test_sql_gives_the_same(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(con.execute(op4_sql()).fetchall())
    assert sorted(map(tuple, op4_licenses(spark, SF).collect())) == want
    texts = [t for _, t in licenses.TEXTS + licenses.NOTICES] + ["sub license sub license licence licence whilst", "Copyright x\nlicence   Programme,centre", "é licence é"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(licenses.canonical(F.col("t"))).collect()]
    assert got == [con.execute(f"select {licenses.canonical_sql('?::varchar')}", [t]).fetchone()[0] for t in texts]


def test_common_texts_and_titles(spark):
    known, short = {}, dict(licenses.TEXTS)
    for i, t in licenses.texts():
        known.setdefault(i, t)
    bsd3 = known["BSD-3-Clause"]
    rows = [
        ("MIT", "MIT License\n\nCopyright (c) 2020 Somebody\n\n" + short["MIT"]), ("MIT", "The MIT License (MIT)\n\n" + short["MIT"]), ("ISC", "ISC License\n\nCopyright 2001 X\n\n" + short["ISC"]),
        ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2020, Somebody\nAll rights reserved.\n\n" + bsd3), ("BSD-3-Clause", re.sub(r"(?m)^[123]\.", "*", bsd3)), ("BSD-2-Clause", known["BSD-2-Clause"]),
        ("Apache-2.0", known["Apache-2.0"].replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2020 Somebody")), ("Apache-2.0", known["Apache-2.0"].partition("   APPENDIX")[0]),
        ("Unlicense", known["Unlicense"].replace("http:", "https:")), *((i, t) for i, t in licenses.texts()), (None, "MIT License"), (None, bsd3[:600]), (None, known["GPL-3.0"] + " more"),
    ]
    docs = spark.createDataFrame([(n, t) for n, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan(docs, licenses.known(spark)).collect()}
    assert [got[n] for n in range(len(rows))] == [i for i, _ in rows]
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense"} <= set(known)
