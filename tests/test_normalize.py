import pytest
from hypothesis import given
from hypothesis import strategies as st

from leafseek.functions.normalize import normalize_text, normalize_with_map, normalize_word, token_text
from leafseek.functions.text import html_unescape_text


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("  Supply chain  RESILIENCE ", "supply chain resilience"),
        ("hyphen-\nbreak", "hyphenbreak"),
        ("ﬁ", "fi"),
        ("WELL-known", "well-known"),
        ("word-\n  next", "wordnext"),
        ("a  \t\n b", "a b"),
        ("   ", ""),
        ("Straße", "strasse"),
        ("a-\nb-\nc", "abc"),
        ("end-\r\nof", "end- of"),
    ],
)
def test_rules(source, expected):
    assert normalize_text(source) == expected
    assert normalize_with_map(source)[0] == expected


def test_map_of_clusters():
    text, mapped = normalize_with_map("Café  line-\nbreak")
    assert text == "café linebreak"
    assert mapped[0] == (1, 1) and mapped[3] == (4, 5) and mapped[4] == (6, 7)


@given(st.text(alphabet=st.sampled_from("aB-ßéﬁ \t\ń 'x"), max_size=40))
def test_both_forms_agree_and_maps_are_monotone(source):
    text, mapped = normalize_with_map(source)
    assert text == normalize_text(source) and len(mapped) == len(text)
    assert all(a[0] <= b[0] and a[1] <= b[1] for a, b in zip(mapped, mapped[1:], strict=False))
    assert all(1 <= a <= b <= len(source) for a, b in mapped)


def test_words_keep_hyphens_and_tokens_lose_marks():
    assert normalize_word("a-\nb") == "a- b"
    assert token_text("c++ well-known café a_b") == " c well known cafe a b "
    assert token_text("++") == ""


def test_entities():
    assert html_unescape_text("&lt;a&gt; &amp;#65; &#x41;&#66; &amp;lt; &#1114112;") == "<a> A AB &lt; &#1114112;"
