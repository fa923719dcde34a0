import pathlib
import re
import textwrap

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from millrace.llm import license, queries
from millrace.llm.common import read
from tests.llm.helpers import FOLDER, documents, rows
from tests.oracle import database, same


def test_known_texts_in_any_dress(spark):
    mit = license.KNOWN[0][1]
    texts = [mit, "Copyright (c) 2020 Someone\n\n" + mit.upper(), re.sub(r"[.,;:()\"]", "", mit).replace(" ", "  "), mit.replace("LICENSE", "LICENCE"), "x" + mit, None, "", "...", mit[:-40], "Licenced under the Apache Licence, version 2.0"]
    got = {r["doc_id"]: r["license_id"] for r in license.scan(documents(spark, texts).withColumnRenamed("source", "license_id")).collect()}
    assert got == {0: "MIT", 1: "MIT", 2: "MIT", 3: "MIT", 4: None, 5: None, 6: None, 7: None, 8: None, 9: "Apache-2.0"}
    assert rows(license.scan(documents(spark, []))) == []


def test_every_known_text_is_found(spark):
    got = license.scan(documents(spark, [t for _, t in license.KNOWN])).orderBy("doc_id").collect()
    assert [r["license_id"] for r in got] == [i for i, _ in license.KNOWN]


def test_usual_wrappings(spark):
    listed = [(i, t) for i, t in license.KNOWN + license.MORE if len(t) > 300]
    wrapped = [(i, "Copyright 2021 Some One\n\n" + "\n\n".join(textwrap.fill(p, n, break_long_words=False) for p in t.split("\n\n"))) for i, t in listed for n in (20, 40, 60, 64, 72, 76, 79, 80)]
    assert sum(bool(re.search("(?im)^copyright (notice|holder|owner)", t)) for _, t in wrapped) > 5
    got = license.scan(documents(spark, [t for _, t in wrapped])).orderBy("doc_id").collect()
    assert [r["license_id"] for r in got] == [i for i, _ in wrapped]


def test_whole_common_texts(spark):
    folder = pathlib.Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3"}
    here = {n: i for n, i in names.items() if (folder / n).exists()}
    if not here:
        pytest.skip("the common licences are not installed")
    texts = [(folder / n).read_text() for n in here]
    plain = ["\n".join(x.strip() for x in t.split("\n")) for t in texts]
    got = license.scan(documents(spark, texts + plain + [t[:-200] for t in texts])).orderBy("doc_id").collect()
    assert [r["license_id"] for r in got] == [*here.values(), *here.values(), *[None] * len(here)]


def test_notice_lines(spark):
    gone = ["Copyright (c) 2020 A", "copyright 2020 a", "Copyright © A", "COPYRIGHT ACME INC", " * Copyright The Authors", "Copyright [yyyy] [name]", "(c) 2020 A", "(c) Copyright A", "© A", "All rights reserved."]
    stay = ["copyright notice and this", "COPYRIGHT HOLDERS BE LIABLE", "Copyright Owner means", "copyright license to", "(c) You must retain", "copyright law: that", "copyrighted by the", "COPYRIGHT AND THE", '"Copyright" also means']
    df = spark.createDataFrame([(t,) for t in gone + stay], "t string")
    left = [r[0] for r in df.select(F.when(license.canonical(F.col("t")) == "", None).otherwise(F.col("t"))).collect()]
    assert left == [None] * len(gone) + stay


def test_matches_are_those_of_the_sql(spark, tmp_path):
    """Copies of whole texts in other case, spelling and wrapping, with notices, beside texts that are none."""
    texts = [None, "", "...", "copyright", "Copyright 2020 A\ncopyright notice", "(c) Copyright\nx", "a\rCopyright 2020 B\rb", "Ünïcode © 2020\n© x", "All rights reserved. x\ny"]
    for k, (_, t) in enumerate(license.KNOWN + license.MORE):
        texts += [t, f"Copyright (c) {1990 + k} Some One\n\n" + t.upper(), "\n\n".join(textwrap.fill(p, 40 + k) for p in t.split("\n\n")), re.sub(r"(?i)\b((?:sub)?licen)s(e)\b", r"\1c\2", t), t + " more", t[5:]]
    folder = pathlib.Path("/usr/share/common-licenses")
    texts += [f.read_text() for f in sorted(folder.iterdir()) if f.is_file()] if folder.exists() else []
    documents(spark, texts).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = database()
    db.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = license.scan(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(db.execute(license.scan_sql()).fetchall(), key=repr)
    found = [r["license_id"] for r in sorted(got, key=lambda r: r["doc_id"])][9:]
    for k, (i, _) in enumerate(license.KNOWN + license.MORE):
        assert found[6 * k : 6 * k + 4] == [i] * 4 and found[6 * k + 4 : 6 * k + 6] == [None] * 2, i


def test_plan_is_native(spark):
    plan = queries.op9_license(spark, FOLDER)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow|ArrowEval", plan)


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    same(spark, database(), queries.queries()[name], queries.oracle_sql()[name])


def test_pipeline_stages(spark):
    docs, before = read(spark, FOLDER, "documents"), None
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, FOLDER).cache()
        assert out.columns == docs.columns
        ids = {r[0] for r in out.select("doc_id").collect()}
        assert before is None or ids <= before
        before, docs = ids, out
        if name == "near-dedup":
            assert out.count() == len(ids)
    last = corpus_pipeline.STAGES[4][1](spark, docs, FOLDER)
    assert last.count() == docs.count() and "n_tokens" in last.columns


def test_stages_keep_columns_of_any_name(spark):
    docs = read(spark, FOLDER, "documents").limit(60)
    names = ("score", "predicted", "lang_pred", "rate", "copies", "n_tokens", "posterior", "kept", "id", "c1", "a.b")
    wide = docs.select("*", *(F.concat(F.lit(f"{n} "), F.col("doc_id")).alias(n) for n in names))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, wide, FOLDER)
        if name == "bpe":
            assert set(wide.columns) - {"text", "n_tokens"} <= set(out.columns) and {"lang", "source", "a.b"} < set(out.columns)
            names = tuple(n for n in names if n != "n_tokens")
        else:
            assert out.columns == wide.columns
        assert out.count() > 0
        assert out.where(" OR ".join(f"`{n}` <> concat('{n} ', doc_id)" for n in names)).count() == 0


def test_of_copies_one_stays(spark):
    base = " ".join(f"w{i}" for i in range(200))
    docs = documents(spark, [base, base, "another text that stands alone here", base, None])
    docs = docs.unionAll(docs.where("doc_id = 1")).unionAll(docs.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    kept = [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER).collect()]
    assert sorted(kept, key=str) == [0, 2, 4, None]


def test_no_text_of_a_shared_id_goes(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(100)) for x in "ab")
    data = [(3, a, "x"), (5, a, "x"), (5, b, "x"), (5, b, "w"), (5, b, None), (7, b, "x")]
    for part in (1, 4):
        docs = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(part)
        kept = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER).collect()]
        assert sorted(kept) == [(3, a, "x"), (5, b, "w")]


def test_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
