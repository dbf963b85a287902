import pytest

from cardinal.plans.card import card_from_dict
from cardinal.plans.config import apply_helpers
from cardinal.plans.flow import CardGraph
from cardinal.plans.groups import resolve_nodes


@pytest.mark.parametrize("element,filled", [
    ({"-v": "rate"}, 0.07),
    ({"-v": "flags"}, ["R", "N"]),
    ({"-s": "flags"}, ["R", "N"]),
    ([{"-s": "flags"}, "A"], ["R", "N", "A"]),
    ([{"-v": "flags"}, "A"], [["R", "N"], "A"]),
    ({"-r": 3}, [1, 2, 3]),
    ([{"-r": 2}, 9], [[1, 2], 9]),
    ({"-r": {"-v": "two"}}, [1, 2]),
    ({"-j": ["l", {"-v": "flags"}]}, ["l_R", "l_N"]),
    ([{"-j": [{"-v": "flags"}, "x", {"-r": {"-v": "two"}}]}], ["R_x_1", "R_x_2", "N_x_1", "N_x_2"]),
    ({"-v": "two", "other": 1}, {"-v": "two", "other": 1}),
    ({"deep": [{"er": {"-v": "rate"}}]}, {"deep": [{"er": 0.07}]}),
    ([], []), ("plain", "plain"), (None, None),
])
def test_each_placeholder(element, filled):
    assert apply_helpers({"k": element}, {"rate": 0.07, "flags": ["R", "N"], "two": 2}) == {"k": filled}


def test_depth_counts_levels_of_what_placeholders_give():
    params = {"l_tax": {"-v": "p_size"}, "p_size": {"-v": "n_name"}, "n_name": "PERU"}
    got = [apply_helpers({"k": {"-v": "l_tax"}}, params, recursive=d)["k"] for d in range(4)]
    assert got == [{"-v": "p_size"}, {"-v": "n_name"}, "PERU", "PERU"]
    spread = {"cols": [{"-v": "first"}, "z"], "first": None}
    params = {"first": "l_tax", "more": [{"-v": "first"}, "l_discount"]}
    assert apply_helpers({"cols": [{"-s": "more"}]}, params, recursive=1) == {"cols": ["l_tax", "l_discount"]}
    assert apply_helpers({"cols": [{"-s": "more"}]}, params) == {"cols": [{"-v": "first"}, "l_discount"]}
    assert apply_helpers(spread, params)["cols"] == ["l_tax", "z"]
    with pytest.raises(KeyError):
        apply_helpers({"k": {"-v": "absent"}}, params)


def test_filled_config_makes_a_card():
    config = {"type": "rescale", "method": {"type": "maxabs"}, "inputs": [{"-j": ["l", ["quantity", "discount"]]}, "l_tax"]}
    assert card_from_dict(apply_helpers(config, {})).inputs == ("l_quantity", "l_discount", "l_tax")


def test_columns_of_nested_groups_and_earlier_nodes():
    """An order rank feeds an encoding, whose columns and twice rescaled prices feed a regression."""
    spec = {
        "groups": {"price": {"cols": ["o_totalprice"]}, "when": {"cols": ["o_orderdate"]}, "numbers": {"groups": ["price"], "cols": ["o_shippriority"]}},
        "nodes": [
            {"label": "rank", "card": {"type": "window_function", "method": "row_number", "output": "nth", "order_by": {"groups": ["when"]}}},
            {"label": "wave", "card": {"type": "gaussian_encoding", "method": {"type": "identity", "max": 12}, "n_components": 3, "input": {"nodes": ["rank"]}}},
            {"label": "log", "card": {"type": "rescale", "method": {"type": "log"}, "suffix": "ln", "inputs": {"groups": ["numbers"]}}},
            {"label": "unit", "card": {"type": "rescale", "method": {"type": "maxabs"}, "suffix": "u",
                                       "inputs": {"groups": ["numbers"], "through": ["log"]}}},
            {"label": "fit", "card": {"type": "interp", "method": "linear", "input": {"nodes": ["rank"]},
                                      "targets": [{"groups": ["numbers"], "through": ["log", "unit"]}, {"cols": ["o_clerk"]}]}},
        ],
    }
    rank, wave, _, unit, fit = (n.card for n in resolve_nodes(spec))
    assert (rank.order_by, wave.input, fit.input) == (("o_orderdate",), "nth", "nth")
    assert unit.inputs == ("o_shippriority_ln", "o_totalprice_ln")
    assert fit.targets == ("o_shippriority_ln_u", "o_totalprice_ln_u", "o_clerk")
    assert CardGraph(resolve_nodes(spec)).layers() == [[0, 2], [1, 3], [4]]
