import pytest

from corvane.plans.query import SearchState, Vocabulary, parse, synonym_groups


def shape(text, vocabulary=None):
    return [[[(" ".join(s.words), s.weight) for s in u.spellings] for u in units] for units in parse(text, vocabulary or Vocabulary())]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (None, []), ("", []), ("?", []), ("a", []), ("or", []), ("and or", []),
        ("xx and yy", [[[("xx", 1.0)], [("yy", 1.0)]]]),
        ("aa or or bb", [[[("aa", 1.0)]], [[("or", 1.0)], [("bb", 1.0)]]]),
        ("xx and yy or zz", [[[("xx", 1.0)], [("yy", 1.0)]], [[("zz", 1.0)]]]),
        ("p-coumaric acid", [[[("coumaric", 1.0), ("pcoumaric", 1.0)], [("acid", 1.0)]]]),
        ("foo-foo", [[[("foo foo", 1.0), ("foofoo", 1.0)]]]),
        ("e. coli cells", [[[("coli", 1.0)], [("cells", 1.0)], [("ecoli", 1.0)]]]),
    ],
)
def test_shapes(text, expected):
    assert shape(text) == expected


def test_synonyms():
    groups = synonym_groups()
    assert len(set(groups.values())) + 0 <= 149
    assert len(groups) == 177
    vocabulary = Vocabulary(groups, {"cell": ("cells",)})
    assert shape("green fluorescent protein cell", vocabulary)[0] == [[("green fluorescent protein", 1.0), ("gfp", 1.0), ("sfgfp", 1.0), ("egfp", 1.0)], [("cell", 1.0), ("cells", 0.35)]]
    assert "her" not in groups
    assert "qs" in groups  # written by hand


def test_state_round_trip():
    state = SearchState("a b", "hybrid", 3, "grid", {"lang": ["en", "fr"]})
    assert SearchState.decode(state.encode(), ["lang"]) == state
    assert SearchState.decode("?page=0&mode=x&lang=EN", ["lang"]) == SearchState("", "lexical", 1, "list", {"lang": ["en"]})
