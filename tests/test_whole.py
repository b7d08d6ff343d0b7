"""Queries do their whole job: nothing that their tables hold is left out."""

from snapweave.plans import fixtures as fx
from snapweave.plans import queries

SF = "/root/testdata/sf0.001"


def test_images_hold_all_documents(spark):
    want = sorted((f"{r.doc_id}.txt", r.sha256, r.size) for r in fx.documents(spark, SF).collect())
    got = queries.image_roundtrip(spark, SF).where("name <> ''").collect()
    assert sorted((r.name, r.sha256, r.size) for r in got) == want
    images = {r.image for r in got}
    assert len(images) > fx.documents(spark, SF).select("lang").distinct().count()
    found = {(r.image, r.message) for r in queries.fsck_superblock(spark, SF).collect()}
    messages = {"magic": "invalid magic", "checksum": "checksum mismatch", "blocks": "zero blocks", "short": "truncated superblock"}
    assert {(f"{i}-{d}", m) for i in images for d, m in messages.items()} <= found
    assert not {i for i, _ in found if i.endswith("-none")}
