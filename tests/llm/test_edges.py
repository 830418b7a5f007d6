"""Odd and empty tables through every operator and the pipeline."""

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from commitlens.llm import ann, licenses, media, mixing, packing, pii, queries, secrets, simhash, toxicity, urlfilter
from commitlens.llm.common import CUT, cut, only, release
from commitlens.llm.toxicity import Model
from tests.llm.test_operators import plain_fingerprint, plain_pii, plain_secrets


def span_digest(spans, kinds):
    text = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], kinds.index(s[0]))))
    return hashlib.sha256(text.encode()).hexdigest(), text


def test_personal_data(odd):
    texts = odd.select("doc_id", "text").collect()
    got = pii.find(odd).collect()
    wanted = collections.Counter()
    for r in texts:
        base = plain_pii(r.text or "")
        wanted[r.doc_id, *(sum(k == kind for k, _, _ in base) for kind in pii.KINDS), span_digest(base, pii.KINDS)[0]] += 1
    assert collections.Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == wanted
    assert all(set(r.base_spans.split(",")) - {""} <= set(r.spans.split(",")) for r in got)


def test_secrets(odd):
    wanted = collections.Counter()
    for r in odd.select("doc_id", "text").collect():
        base = plain_secrets(r.text or "")
        wanted[r.doc_id, span_digest(base, ["assign", "access", "hex"])[0]] += 1
    assert collections.Counter((r.doc_id, r.base_sha256) for r in secrets.find(odd).collect()) == wanted


def test_fingerprints_and_components(odd):
    got = simhash.near_duplicates(odd).collect()
    prints = collections.Counter((r.doc_id, plain_fingerprint(r.text)) for r in odd.select("doc_id", "text").collect())
    assert collections.Counter((r.doc_id, r.fp % (1 << 64)) for r in got) == prints
    zero = {r.component_id for r in got if r.fp == 0}
    assert zero == {2} and {r.component_id for r in got if r.doc_id in (6, 7)} == {5}


def test_mix(odd):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count() and all(0 <= r.taken <= 3 * r.size for r in got)
    assert all(r.size == 0 for r in got if r.doc_id in (2, 3, 4))
    times = collections.Counter(r.doc_id for r in mixing.repeat(odd).collect())
    assert times and mixing.repeat(odd).columns == odd.columns


def test_rewriting_stages_keep_rows_and_columns(odd):
    red = pii.redact(odd)
    assert red.schema.simpleString() == odd.schema.simpleString() and red.count() == odd.count()
    one = {r.doc_id: r for r in red.collect()}
    assert one[1].text == "Mail [EMAIL] or call [PHONE]. All rights reserved." and one[1].n_chars == len(one[1].text) and one[2].text is None
    model = Model({"licensed": 40.0}, -20.0)
    kept = toxicity.keep_clean(odd, model)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in odd.collect() if r.doc_id != 9)


def test_one_of_each_keeps_first_rows(odd):
    left = simhash.one_of_each(odd)
    ids = [r.doc_id for r in left.collect()]
    assert left.columns == odd.columns
    # 5, 6, 7 and 5's repeats are one group, null, empty and blank another; another text of id 5 and the null id stay
    assert sorted(map(str, ids)) == sorted(["1", "2", "5", "5", "8", "9", "10", "11", "None"])


def test_urls_and_vectors_over_odd_and_empty_tables(spark, tmp_path):
    urls = ["http://m.casino-win.example.com/x", None, "", "no scheme", "http://" + "a." * 3000 + "test/" + "p" * 100_000, "http://m.casino-win.example.com/x"]
    pages = spark.createDataFrame([(i if i != 3 else None, u, "h", "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, key string")
    vectors = [(0, [1.0, 2.0]), (None, [1.0, 1.0]), (50, None), (7, [0.0, 0.0]), (8, [1.0, float("nan")]), (9, [2.0, 4.0]), (9, [2.0, 4.0]), (100, [1.0])]
    embeddings = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<double>, place int")
    for part, rows in ((1, (6, 1)), (0, (0, 0))):
        where = str(tmp_path / str(part))
        (pages if part else pages.limit(0)).write.parquet(f"{where}/pages.parquet")
        (embeddings if part else embeddings.limit(0)).write.parquet(f"{where}/embeddings.parquet")
        found = queries.QUERIES["op6_url_bloom_cascade"](spark, where).collect(), queries.QUERIES["op8_nearest_hilbert_curves"](spark, where).collect()
        assert tuple(map(len, found)) == rows
        assert not part or ([r.verdict for r in found[0]].count("block"), tuple(found[1][0])) == (2, (0, 1, 9, pytest.approx(1)))


def write_tables(where, docs, marks):
    docs.write.parquet(f"{where}/documents.parquet")
    marks.write.parquet(f"{where}/labels.parquet")


def test_the_pipeline_over_odd_and_empty_tables(spark, odd, none, tmp_path):
    labels = spark.createDataFrame([(1, 1, 1), (9, 0, 0), (None, 1, 1), (77, 1, None)], "doc_id long, quality int, toxic int")
    write_tables(tmp_path / "odd", odd, labels)
    write_tables(tmp_path / "none", none, labels)
    write_tables(tmp_path / "unlabelled", odd, labels.limit(0))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    for where in ("odd", "unlabelled"):
        docs = odd
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = cut(stage(spark, docs, str(tmp_path / where)))
            assert docs.columns == odd.columns
            if name == "toxicity":
                assert docs.count() == odd.count()  # no class has the three documents that a word needs to tell
            if name == "near_duplicates":
                assert sorted(str(r.doc_id) for r in docs.collect()) == sorted(["1", "2", "5", "5", "8", "9", "10", "11", "None"])
        pieces, took = corpus_pipeline.run(spark, str(tmp_path / where)), collections.Counter(str(r.doc_id) for r in docs.collect())
        whole = collections.Counter(str(r.doc_id) for r in pieces.collect() if r.start + r.length == r.doc_tokens)
        assert whole == took and set(took) >= {"1", "8"}


def test_a_stage_releases_what_it_is_done_with(small):
    before = list(CUT)
    kept = only(lambda: simhash.one_of_each(small))
    assert CUT == [*before, kept] and kept.count() > 0
    release(kept)
    assert CUT == before


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in ("op6_url_bloom_cascade", "op8_nearest_hilbert_curves")])
def test_queries_over_odd_and_empty_tables(spark, odd, none, tmp_path, name):
    labels = spark.createDataFrame([(1, 1, 1), (9, 0, 0), (9, 0, 1), (None, 1, 1), (77, 1, None)], "doc_id long, quality int, toxic int")
    for docs, marks, rows in ((odd, labels, odd.count()), (none, labels.limit(0), 0)):
        where = str(tmp_path / str(rows))
        docs.write.parquet(f"{where}/documents.parquet")
        marks.write.parquet(f"{where}/labels.parquet")
        got = queries.QUERIES[name](spark, where)
        n = got.count()
        assert n >= rows if rows and name.startswith("op3") else n == rows


def test_empty_urls_and_vectors(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert urlfilter.judge(pages, urlfilter.listed_addresses(pages)).count() == 0
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_media_of_equal_texts_is_equal(odd):
    rows = media.described(media.store(odd)).collect()
    by = collections.defaultdict(set)
    for r in rows:
        by[r.payload_sha256].add((r.n_bytes, r.payload_bytes, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature))
    assert all(len(v) == 1 for d, v in by.items() if d != hashlib.sha256(bytes(64)).hexdigest())


def test_scores_do_not_depend_on_rows_around(odd):
    model = Model({"call": 3.0, "lic*": 1.0}, -2.0)
    a = sorted(map(str, toxicity.score(odd, model).collect()))
    assert a == sorted(map(str, toxicity.score(odd.repartition(1), model).collect()))
    assert licenses.scan(odd).count() == odd.count() and packing.decompose(odd).filter(F.col("doc_tokens") == 1).count() == 2
