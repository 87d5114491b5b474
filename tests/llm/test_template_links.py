from leadloom.llm import jaccard


def test_short_texts_with_one_template(docs, spark, tmp_path, monkeypatch):
    """20,000 texts with ten words in common and two of their own: hardly any document meets another group."""
    template = "thank you for your order it will be sent soon"
    rows = [f"{template} a{k} b{k}" for k in range(20_000)] + [f"{template} a5 b5 c5 d5 e5 f5 g5 h5 i5 j5 k5 l5 m5 n5 o5 p5 q5 r5 s5 t5{x}" for x in ("", " u5", " v5")]
    sizes = {}
    saved = jaccard.saved
    monkeypatch.setattr(jaccard, "saved", lambda df, name: sizes.setdefault(name, saved(df, name)))
    found = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs(rows)).collect()}
    assert sizes["met"].count() < 5 * len(rows) and sizes["postings"].count() < 10 * len(rows)
    assert all(found[i] == i for i in range(20_000)) and {found[i] for i in range(20_000, 20_003)} == {20_000}
