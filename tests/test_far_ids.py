"""Documents with null, negative and very great ids in the model."""

from __future__ import annotations

from siltstone import model

IDS = [0, 5, (1 << 38) - 1, 1 << 38, 1 << 39, 1 << 60, (1 << 63) - 1, -1, -(1 << 62), None]


def test_any_ids(spark, tmp_path):
    rows = [(i, f"statement number {k} stands here alone. A sentence that every document shares. Another one {k} that ends it.", "en", "s", 90) for k, i in enumerate(IDS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    sf_dir = str(tmp_path)
    assert {r.event_id for r in model.kb_events(spark, sf_dir).collect()} == {i for i in IDS if i is not None}
    s = model.kb_statements(spark, sf_dir).collect()
    assert len(s) == len({r.number for r in s}) == 3 * (len(IDS) - 1)
    assert all(r.number == r.event_id * model.ROOM + r.pos for r in s if 0 <= r.event_id < model.FAR_IDS) and all(r.number >= 0 for r in s)
    far = {r.event_id: r.number // model.ROOM for r in s if not 0 <= r.event_id < model.FAR_IDS}
    assert [far[i] for i in sorted(far)] == [model.FAR_IDS + k for k in range(len(far))]
    claims = model.kb_claims(spark, sf_dir)
    assert claims.count() == 2 * (len(IDS) - 1) + 1
    assert model.kb_evidence(spark, sf_dir).count() == 3 * (len(IDS) - 1)
    for frame in (model.kb_edges, model.kb_trusted, model.kb_postings, model.kb_sizes):
        assert frame(spark, sf_dir).count() > 0
