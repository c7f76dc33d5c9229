"""Problem 9 in spaceless scripts: the dictionary of the corpus, the lattice, and what it decides."""

import pytest

from auralake.llm import sentences, words


def split(t, lattice=None):
    return [t[a:b] for a, b in sentences.sentences(t, lattice)]


#: No terminator stands between these sentences, and no blank between most: only words tell.
UNMARKED = [
    ["วันนี้อากาศดีครับ", "ขอบคุณที่รับฟัง"], ["รายการสนุกมากค่ะ", "ทำไมตลาดถึงเงียบ"], ["今日は港の話をします", "しかし市場は静かです", "そして冬です"], ["你喜欢运动吗", "我们今天聊天气吧", "但是很复杂"],
    ["ມື້ນີ້ດີຄັບ", "ຂອບໃຈທີ່ຟັງ"], ["ថ្ងៃនេះល្អហើយ", "អរគុណសម្រាប់ការស្តាប់"], ["ဒီနေ့ကောင်းပါတယ်", "ဒါပေမဲ့ဈေးတိတ်ဆိတ်ပါတယ်"],
]


@pytest.mark.parametrize("want", UNMARKED, ids=range(len(UNMARKED)))
def test_words_part_sentences(want):
    assert split("".join(want)) == want
    if not "฀" <= want[0][0] <= "๿":
        assert split(" ".join(want)) == want
        assert split(want[0][:3] + " " + want[0][3:]) == [want[0][:3] + " " + want[0][3:]]  # a blank alone parts nothing


def test_words_that_hold_particles():
    """What looks like a particle inside a longer word is none: so the lattice is needed, no search for strings."""
    for t in ("ますます今日の話は大切です", "酒吧我们常去", "他们在网吧今天开会"):
        assert split(t) == [t]


class Constant(words.Lattice):
    """A lattice that reads every stretch as one word."""

    def words(self, run):
        return ((0, len(run)),)


def test_a_constant_lattice_fails():
    assert all(split("".join(w), Constant()) != w for w in UNMARKED)


def test_the_corpus_makes_the_dictionary(spark, data):
    rows = [x + w + y for x in "犬猫港冬本" for w in ("不思議", "天気") for y in "はがをにで"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows + [None, "", "only latin"])], "doc_id long, text string, gram string")
    d = words.corpus_dictionary(df)
    assert "不思議" in d and "天気" in d and "思議" not in d and "不思" not in d
    lattice = words.Lattice(d)
    assert ["犬天気と不思議"[a:b] for a, b in lattice.words("犬天気と不思議")] == ["犬", "天気", "と", "不思議"]
    assert words.corpus_dictionary(df.limit(0)) == {}
    docs = spark.read.parquet(f"{data}/documents.parquet")
    lattice = words.Lattice(words.corpus_dictionary(docs))
    for r in docs.collect():
        sentences.sentences(r.text or "", lattice)
    assert lattice.calls > 0


def test_titles_of_names():
    assert split("El Sr. Roe y la Sra. Paz. Vino Ann Lee Sr. Then we left.") == ["El Sr. Roe y la Sra. Paz.", "Vino Ann Lee Sr.", "Then we left."]
