import pyarrow as pa
import public_tokenizers
import pytest

from corpusloom.llm import arrow, jaccard_join, packing, pii, quality

OPERATORS = {
    "quality": lambda docs: quality.weigh(docs, quality.Model(quality.log_ratio(*[quality.np.zeros(quality.BUCKETS)] * 2))),
    "jaccard_join": lambda docs: jaccard_join.keep_first(docs),
    "pii": lambda docs: pii.mask_pii(docs),
    "packing": lambda docs: packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")),
}


def sizes(batches):
    for b in batches:
        yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})


@pytest.mark.parametrize("name", OPERATORS)
def test_no_task_sends_python_more_than_a_slice_and_a_row(spark, name):
    fresh = spark.newSession()
    docs = fresh.range(3000, numPartitions=1).selectExpr("id AS doc_id", "repeat(concat('w', cast(id AS string), ' '), 1000) AS text")
    OPERATORS[name](docs)
    got = docs.mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r.rows for r in got) == 3000 and max(r.bytes for r in got) <= arrow.SLICE_BYTES


def test_a_caller_s_bound_stays(spark):
    fresh = spark.newSession()
    fresh.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
    docs = fresh.range(9).selectExpr("id AS doc_id", "'a b c' AS text")
    assert pii.mask_pii(docs).count() == 9 and fresh.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1m"
