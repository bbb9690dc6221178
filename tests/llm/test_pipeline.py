import numpy as np
import pytest

import corpus_pipeline as cp
from silt.llm import minhash as mh
from silt.llm.common import WordHash


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(55)
    rows = []
    for i in range(40):
        rows.append((i, prose(100), "en", f"s{i % 7}"))
    rows += [(40 + i, prose(60) + " " + passage + " " + prose(60), "en", f"s{i}") for i in range(4)]
    rows += [(50 + i, rows[i][1], "en", "s1") for i in range(3)] + [(60, rows[5][1] + " end", "en", "s2"), (7, rows[7][1], "en", "s0")]
    rows += [(70 + i, " ".join(word() + "###" for _ in range(80)), "en", "s3") for i in range(20)]
    rows += [(90, None, None, None), (91, "", "en", "s1"), (92, "too short", "en", "s1"), (93, prose(50) + ' token = "q7Zk29xLw0PvTr8sYb3N" ' + prose(50), "en", "s1")]
    rows += [(94 + i, prose(50) + " password: letmein12345 " + prose(50), "en", f"s{i}") for i in range(4)]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, n_words int")
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in [*range(40), *range(70, 90)]], "doc_id long, quality int, toxic int")
    d = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    return d, passage


def test_stages(spark, tables):
    d, passage = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    kept = cp.quality_rules(spark, docs, d)
    ids = sorted(r.doc_id for r in kept.select("doc_id").collect())
    assert kept.columns == columns and not {*range(70, 93)} & {*ids} and {*range(44), 50, 60, 93, 94} <= {*ids} and ids.count(7) == 2

    one = cp.near_duplicates(spark, kept, d)
    ids = sorted(r.doc_id for r in one.select("doc_id").collect())
    assert one.columns == columns and ids == [*range(44), 93, 94, 95, 96, 97]
    known = WordHash()
    sets = [mh.weighted_shingles(r.text, known) for r in one.collect()]
    assert all(mh.similarity(a, b) < 0.8 for i, a in enumerate(sets) for b in sets[:i])

    cut = cp.repeated_passages(spark, one, d)
    texts = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == columns and len(texts) == 49
    assert all(passage[5:-5] not in texts[i].text and len(texts[i].text) > 300 for i in range(40, 44))
    before = {r.doc_id: r.text for r in one.collect()}
    assert all(texts[i].text == before[i] for i in range(40)) and all(r.n_chars == len(r.text) for r in texts.values())

    safe = cp.secret_values(spark, cut, d)
    after = {r.doc_id: r.text for r in safe.collect()}
    assert safe.columns == columns and 'token = "[SECRET]"' in after[93] and "letmein12345" in after[94]
    assert all(after[i] == texts[i].text for i in range(44))

    pieces = cp.best_fit(spark, safe, d).toPandas()
    assert sorted(pieces.doc_id.unique()) == sorted(after)


def test_run(spark, tables):
    assert cp.run(spark, tables[0]).count() >= 49


def test_stages_on_an_empty_table_and_very_long_texts(spark, tables, tmp_path):
    d, _ = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in rng.integers(0, 9000, 200_000)]
    long = [(1, " ".join(words), "en", "s1"), (2, " ".join(words[:90_000]) + " secret: q7Zk29xLw0PvTr8sYb3N", "en", "s2"), (3, None, None, None)]
    rows = spark.createDataFrame([(*r, len(r[1] or ""), None) for r in long], docs.schema)
    for some, ids in ((docs.limit(0), []), (rows, [1, 2])):
        kept = some
        for name, stage in cp.STAGES[:-1]:
            kept = stage(spark, kept, d)
            assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.select("doc_id").collect()) == ids, name
        assert sorted({r.doc_id for r in cp.best_fit(spark, kept, d).collect()}) == ids


def test_columns_of_any_name(spark, tables):
    """Every name that a stage's module gives to a column of its own may be a column of the documents; they come out as they went in."""
    import re
    from pathlib import Path

    d, _ = tables
    names = {"row", "new_", "key_", "first_", "n_", "k_"}
    for m in ("common", "rules", "minhash", "suffix", "secrets", "packing"):
        source = Path(cp.__file__).with_name("silt").joinpath("llm", f"{m}.py").read_text()
        names |= {x for found in re.findall(r'alias\("(\w+)"\)|withColumn\("(\w+)"| AS (\w+)\b', source) for x in found if x}
    names = sorted({n.lower() for n in names} - {"doc_id", "text", "lang", "source", "n_chars"})
    assert {"key", "node", "n", "root", "first_id"} <= set(names)
    docs = spark.read.parquet(f"{d}/documents.parquet").drop("n_words")
    extra = docs.selectExpr("*", *[f"concat('{n}', doc_id) AS `{n}`" for n in names])
    kept = extra
    for name, stage in cp.STAGES[:-1]:
        plain = {r.doc_id: r.text for r in stage(spark, kept.select(docs.columns), d).collect()}
        kept = stage(spark, kept, d)
        assert kept.columns == extra.columns, name
        rows = kept.collect()
        assert {r.doc_id: r.text for r in rows} == plain, name
        assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names), name
    assert cp.best_fit(spark, kept, d).count() > 0
