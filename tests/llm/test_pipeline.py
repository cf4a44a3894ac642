import hashlib
import random
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest

from haulgrid.llm.bpe import codec
from haulgrid.llm.mixing import mix_sources
from haulgrid.llm.simhash import fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before the first stage and after each."""
    from haulgrid.llm.common import materialize, table

    docs = table(spark, SF, "documents")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs, _ = materialize(stage(spark, docs, SF), name)
        seen.append(docs)
    return seen


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_keep_the_columns_of_documents(stages):
    assert all(s.columns == stages[0].columns and s.dtypes == stages[0].dtypes for s in stages[:-1])


def test_quality_stage_keeps_the_clean(spark, stages):
    before, after = rows(stages[0]), rows(stages[1])
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        if r.doc_id in before and len(before[r.doc_id].text.split()) >= 50:
            assert (r.doc_id in after) == bool(r.quality)
    assert all(after[i] == before[i] for i in after)


def test_line_stage_cuts_only_lines_seen_before(stages):
    before, after = rows(stages[1]), rows(stages[2])
    seen = set()
    for i in sorted(before):
        lines = before[i].text.split("\n")
        left = after[i].text.split("\n") if i in after else []
        cut = Counter(lines) - Counter(left)
        assert not Counter(left) - Counter(lines)
        new = [x for x in lines if len(x) >= 20 and x not in seen]
        assert set(cut) - {""} <= {x for x in lines if len(x) >= 20}
        assert all(x in left or x in cut for x in new)
        seen |= set(lines)
        if i in after:
            assert after[i].n_chars == len(after[i].text)


def test_near_dedup_stage_against_all_pairs(stages):
    before, after = rows(stages[2]), rows(stages[3])
    fps = {i: fingerprint(r.text) for i, r in before.items()}
    ids = sorted(fps)
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    assert set(after) == {i for i in ids if top(i) == i}


def test_mix_and_token_stages(stages):
    copies = {r.doc_id: r.copies for r in mix_sources(stages[3]).collect()}
    mixed = Counter(r.doc_id for r in stages[4].collect())
    assert mixed == Counter({i: n for i, n in copies.items() if n})
    text = {r.doc_id: r.text for r in stages[3].collect()}
    c = codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    out = stages[5].collect()
    assert Counter(r.doc_id for r in out) == mixed
    for r in out:
        ids = c.encode(text[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(ids).hexdigest() and r.n_tokens == len(np.frombuffer(ids, "<u4"))
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_odd_rows_pass_all_stages(spark, tmp_path):
    rnd = random.Random(1)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    made = [(i, " ".join(rnd.choice(words) + str(rnd.randrange(99)) for _ in range(80)), "en", rnd.choice(["a", "b", None]), 5, "x") for i in range(40)]
    made += [(100, None, None, None, None, None), (None, made[0][1] + " more", "en", "a", 1, "x"), (101, "", "en", "a", 0, "x"), made[1], made[1]]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, h string"
    for name, data in (("some", made), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        ids = defaultdict(int)
        for r in out.collect():
            ids[r.doc_id] += 1
        assert (100 not in ids and 101 not in ids and len(ids) > 20) if data else not ids
