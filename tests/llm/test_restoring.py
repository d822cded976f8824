import numpy as np
import pytest
from test_search_and_scores import restorer

from tuneloom.llm import toxicity


@pytest.mark.parametrize("written, meant", [
    ("k r u m p f!", "krumpf"), ("k r u m p f.", "krumpf"), ("k r u m p f,", "krumpf"), ("(k r u m p f)", "krumpf"),
    ("k  r  u  m  p  f", "krumpf"), ("k\tr\tu\tm\tp\tf", "krumpf"), ("k\nr\nu\nm\np\nf", "krumpf"), ("b l 4 $ t ! c", "blastic"),
    ("t h e", "the"), ("2024", "2024"), ("10,000", "10,000"), ("$1,250", "$1,250"), ("12:30", "12:30"), ("555-0123", "555-0123"),
])
def test_forms(written, meant):
    assert restorer().restore(written) == meant
    if "  " in written or "\n" in written or written[-1] in "!.,":
        assert meant in restorer().spelled(written)


@pytest.mark.parametrize("written, meant", [("455", "ass"), ("4$$", "ass"), ("7175", "tits"), ("4-$-$", "ass"), ("1999", "1999"), ("555-0123", "555-0123")])
def test_stand_ins_alone(written, meant):
    import numpy as np

    text = " ".join("the ass sat on its tits in this last nest and asked for more grass to pass the class".split() * 40)
    s = np.concatenate(([0, 0], toxicity.symbols(text), [0, 0]))
    counts = np.zeros((toxicity.SYMBOLS,) * 3)
    np.add.at(counts, (s[:-2], s[1:-1], s[2:]), 1)
    assert toxicity.Restorer(toxicity.CharModel(counts)).restore(written) == meant


def test_a_worker_holds_a_word_once():
    restorer = toxicity.Restorer(toxicity.CharModel(np.ones((toxicity.SYMBOLS,) * 3)), 0)
    assert restorer.reading("word,") == ["word"] and not restorer._readings
    assert toxicity.Restorer(toxicity.CharModel(np.ones((toxicity.SYMBOLS,) * 3))).reading("word,") == ["word"]
