import pytest

from lexispan.functions.stemming import STEMMERS, stem


@pytest.mark.parametrize(
    ("language", "word", "want"),
    [
        ("es", "chicas", "chic"),
        ("es", "chicharrones", "chicharron"),
        ("es", "canción", "cancion"),
        ("es", "hablábamos", "habl"),
        ("es", "torneos", "torne"),
        ("es", "rápidamente", "rapid"),
        ("sv", "jaktkarlarne", "jaktkarl"),
        ("sv", "klostergården", "klostergård"),
        ("sv", "klokheten", "klok"),
        ("no", "havnedistriktene", "havnedistrikt"),
        ("no", "opninga", "opning"),
        ("da", "indtagelse", "indtag"),
        ("da", "underste", "underst"),
        ("da", "venlighed", "ven"),
        ("ru", "важнейшими", "важн"),
        ("ru", "красивыми", "красив"),
        ("ru", "вавилонского", "вавилонск"),
        ("en", "running", "run"),
        ("de", "häusern", "haus"),
    ],
)
def test_stems(language, word, want):
    assert stem(word, language) == want


def test_any_text_has_a_stem():
    for language in STEMMERS:
        for word in ["", "a", "0", "ss", "и", "über", "no", "les", "日本", "x" * 300]:
            assert isinstance(stem(word, language), str)
