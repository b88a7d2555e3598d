"""Changes of a manifest: odd rows and the record that goes with a document."""

from quarry.operators import manifest as records

ROWS = [("s1", "R15", "i10", "a", "/in/38300-i10.docx"), ("s1", "R16", "i10", "b", "/in/38300-i10-2.docx"), ("s2", "R15", "i10", "c", None), ("s3", "R17", None, "d", "/in/38.docx")]


def manifest(spark, rows=ROWS):
    return spark.createDataFrame(rows, "spec_number string, release string, version string, sha256 string, file_path string")


def test_first_record_of_each_document(spark):
    asked = spark.createDataFrame([("38300-i10",), ("38",), ("none",), ("",), (None,), ("38",)], "doc_id string")
    found = {r.doc_id: (r.spec_number, r.release) for r in records.records_of(manifest(spark), asked).collect()}
    assert found == {"38300-i10": ("s1", "R15"), "38": ("s1", "R15"), "none": (None, None), "": (None, None), None: (None, None)}
    assert records.records_of(manifest(spark), asked.limit(0)).count() == 0
    assert [tuple(r) for r in records.records_of(manifest(spark, []), asked.filter("doc_id = '38'")).collect()] == [("38", None, None)]


def test_deleting_documents_with_their_records(spark):
    chunks = spark.createDataFrame([(1, "38300-i10"), (2, "38300-i10"), (3, "other"), (4, None)], "id long, doc_id string")
    left, kept, told = records.delete_documents(chunks, manifest(spark), spark.createDataFrame([("38300-i10",), ("gone",)], "doc_id string"))
    assert sorted(r.id for r in left.collect()) == [3, 4]
    assert sorted((r.spec_number, r.release) for r in kept.collect()) == [("s1", "R16"), ("s2", "R15"), ("s3", "R17")]
    assert sorted(tuple(r) for r in told.collect()) == [("38300-i10", 2, "s1|R15"), ("gone", 0, None)]
    assert records.clear(kept).count() == 0


def test_checks_of_new_and_versionless_rows(spark):
    offered = spark.createDataFrame([("s1", "R15", "i20", "z"), ("s1", "R16", "i10", "b"), ("s9", "R15", "i10", "a"), ("s3", "R17", "i10", "d")], "spec_number string, release string, version string, sha256 string")
    found = {(r.spec_number, r.release): (r.known, r.same_hash, r.should_replace) for r in records.checks(manifest(spark), offered).collect()}
    assert found[("s1", "R15")] == (True, False, True) and found[("s1", "R16")] == (True, True, False) and found[("s9", "R15")] == (False, False, False)
    assert found[("s3", "R17")][:2] == (True, True)
