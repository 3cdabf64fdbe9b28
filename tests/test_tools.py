"""Tools by name over small files."""

import pytest

from patternloom import tools


def test_tools(spark, tmp_path):
    (tmp_path / "corpus").write_text("d1\ta x b a y b\nd2\ta z b\n")
    (tmp_path / "seeds").write_text("1\ta|b\t*\t1\n")
    common = {"corpus_path": str(tmp_path / "corpus"), "corpus_class": "lines", "extractor_class": "ngram", "extractor_args": "1:1:1:0:l*r"}
    got = tools.run(spark, "context_to_pattern", seeds_path=str(tmp_path / "seeds"), **common)
    assert sorted((r.pattern, r.matches, r.global_context_count) for r in got.collect()) == [("x", 1, 3), ("y", 1, 3), ("z", 1, 3)]
    two = tools.run(spark, "context_pattern_pairs", **common | {"extractor_class": "multi", "extractor_args": "cooccur|1|ngram|1:1:1:0:l"})
    assert two.where("context = 'd2'").count() == 3
    assert tools.run(spark, "bootstrap_contexts", input_path=str(tmp_path / "seeds"), scorer_class="likelihood", **common).count() == 1
    with pytest.raises(TypeError):
        tools.run(spark, "context_to_pattern", corpus_path="x")
    with pytest.raises(ValueError):
        tools.run(spark, "none")


def test_parameters(tmp_path):
    (tmp_path / "p.tsv").write_text("input_path\tx\nnum_results\t3\n")
    assert tools.parameters([str(tmp_path / "p.tsv")]) == {"input_path": "x", "num_results": "3"}
    assert tools.parameters(["-input_path=x", "-a=b=c"]) == {"input_path": "x", "a": "b=c"}
