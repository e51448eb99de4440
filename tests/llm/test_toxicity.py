"""Insults with a mark between all letters."""

import pytest

from tidemark.llm import toxicity


@pytest.mark.parametrize("word", ["i.d.i.o.t", "i-d-i-o-t!", "i_d*i_o*t"])
def test_marks_between_all_letters_cost_nothing(word):
    units = toxicity.normal(word)
    assert toxicity.Landmarks(["idiot"]).kernels(units)[:, 0].max() > 0.9
    assert toxicity.normal("well-known") == ["well-known", "wellknown"] and toxicity.normal("plain,") == ["plain"] and toxicity.normal("--") == []
