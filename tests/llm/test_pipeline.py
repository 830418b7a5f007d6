"""The pipeline's stages, each against a plain model on its own input."""

import collections
import random

import pytest

import corpus_pipeline
from commitlens.llm import packing, pii, simhash, toxicity
from commitlens.llm.common import cut
from tests.llm.test_operators import plain_roots, plain_score

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = cut(stage(spark, docs, SF))
        seen.append((name, docs, out))
        docs = out
    return {name: (before, after) for name, before, after in seen}


def rows(frame):
    return collections.Counter(map(tuple, frame.collect()))


def test_columns_last_through_all_stages_but_the_last(spark, stages):
    wanted = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(after.columns == wanted for name, (_, after) in stages.items() if name != "packing")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "pii", "mixing", "packing"]


def test_toxic_documents_go_and_others_stay(spark, stages):
    before, after = stages["toxicity"]
    model = toxicity.fit(toxicity.sample(before, spark.read.parquet(f"{SF}/labels.parquet")))
    assert rows(after) == collections.Counter(t for t in map(tuple, before.collect()) if plain_score(model, t[1] or "") < 0.5)


def meets(x, y, rule=simhash.STAGE):
    """Whether two texts' prints link: in a bucket of a table, by one print or by it and the next."""
    apart = [(p ^ q) for p, q in zip(x, y, strict=True)]
    near = [d.bit_count() for d in apart]
    masks = simhash.covering_masks(rule.radius, rule.bits)
    return any(any(not d & m for m in masks) and (n <= rule.radius or n + near[(i + 1) % len(near)] <= rule.wide) for i, (d, n) in enumerate(zip(apart, near, strict=True)))


def test_one_document_of_each_group_stays(stages):
    before, after = stages["near_duplicates"]
    prints = {r.doc_id: simhash.fingerprints_of(r.text, simhash.STAGE_SHINGLE, simhash.STAGE_PRINTS, distinct=True) for r in before.collect()}
    wanted = plain_roots(prints, meets)
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(wanted.values())) and len(set(wanted.values())) < len(wanted)


def apart(n, least):
    """``n`` numbers of 16 bits, each two of which differ in at least ``least``."""
    found = []
    for x in range(1 << 16):
        if len(found) < n and all((x ^ y).bit_count() >= least for y in found):
            found.append(x)
    return found


@pytest.mark.parametrize(("seed", "bucket_rows"), [(1, 4096), (1, 16), (2, 1)])
def test_wide_links_are_whole_in_large_buckets(spark, seed, bucket_rows):
    """First prints that agree under all masks, so each of their buckets holds every member, and no link by the radius."""
    r, rule = random.Random(seed), simhash.Rule(bits=48, wide=20, bucket_rows=bucket_rows)
    centre, groups = r.getrandbits(64), [r.getrandbits(64) for _ in range(25)]
    flip = lambda x, n: x ^ sum(1 << p for p in r.sample(range(64), n))
    points = {i: (centre ^ top << 48, flip(r.choice(groups), 6)) for i, top in enumerate(apart(100, 5))}
    members = spark.createDataFrame([(i, list(map(simhash.signed, v))) for i, v in points.items()], "node long, fps array<long>")
    got = {x.node: x.root for x in simhash.roots(members, 2, rule).collect()}
    wanted = plain_roots(points, lambda x, y: meets(x, y, rule))
    assert 25 <= len(set(wanted.values())) <= 75
    assert {i: got.get(i, i) for i in points} == wanted


def test_copies_with_an_overlap_of_four_fifths_are_found(spark):
    r, docs, words = random.Random(4), {}, [f"w{i}" for i in range(5000)]
    overlap = lambda a, b: len(a & b) / len(a | b)
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    while len(docs) < 400:
        base = [r.choice(words) for _ in range(300)]
        new = list(base)
        for _ in range(r.randrange(2, 7)):
            new[r.randrange(300)] = r.choice(words)
        if overlap(shingles(base), shingles(new)) >= 0.8:
            docs |= {len(docs): " ".join(base), len(docs) + 1: " ".join(new)}
    left = {x.doc_id for x in simhash.one_of_each(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert left >= set(range(0, 400, 2)) and len(left) <= 200 + 0.1 * 200


def test_personal_data_gives_way(stages):
    before, after = stages["pii"]
    new = {r.doc_id: r for r in after.collect()}
    for r in before.collect():
        ((base, added),) = pii.all_spans([r.text], pii.fitted())
        assert new[r.doc_id].text == pii.redacted(r.text, base + added) and new[r.doc_id].n_chars == len(new[r.doc_id].text)
        assert base or added or new[r.doc_id].text == r.text


def test_mix_repeats_whole_documents(stages):
    before, after = stages["mixing"]
    texts, times = rows(before), rows(after)
    assert set(times) <= set(texts) and max(times.values()) <= 3
    assert abs(sum(len(t[1].split()) * n for t, n in times.items()) / sum(len(t[1].split()) * n for t, n in texts.items()) - 1) < 0.15


def test_packing_covers_each_repetition(stages):
    before, after = stages["packing"]
    encode = packing.encoder(*packing.default_files())
    wanted = collections.Counter()
    for r in before.collect():
        wanted[r.doc_id] += len(encode(r.text or "")) + 1
    got = collections.Counter()
    for r in after.collect():
        got[r.doc_id] += r.length
    assert got == wanted


def test_run_gives_the_last_stage(spark, stages):
    assert corpus_pipeline.run(spark, SF).drop("sequence_id").exceptAll(stages["packing"][1].drop("sequence_id")).isEmpty()
