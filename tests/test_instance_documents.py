"""Annotation documents stay bounded however many lines there are."""

from __future__ import annotations

from lumenforge.plans import proofs


def test_documents_grow_in_number_not_in_size(spark, monkeypatch, tmp_path):
    rows = spark.range(300).selectExpr("id % 150 AS l_orderkey", "id AS l_partkey", "id % 20 AS l_suppkey", "cast(id % 4 AS int) AS l_linenumber", "1.0D AS l_quantity")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    roots, real = [], proofs.I.instances
    monkeypatch.setattr(proofs.I, "instances", lambda s, root, which: roots.append(root) or real(s, root, which))
    monkeypatch.setattr(proofs, "DOCUMENT", 3)
    got = proofs.s17_instances(proofs.Tables(spark, str(tmp_path))).count()
    assert got == rows.where("l_suppkey % 9 < 7").count()
    sizes = spark.read.json(f"{roots[0]}/{proofs.I.annotated_set('ade20k_instance_val').annotations}").selectExpr("size(annotations) AS n").collect()
    assert len(sizes) == 100 and max(r.n for r in sizes) <= 4
