"""Problem 2: what is a note and what is speech; nothing hinges on a length."""

import pytest

from auralake.llm import turns

SEG = "episode_id long, seg_index int, text string, words string"


def words(t):
    noise, _ = turns.scan(t)
    return turns._without(t, 0, len(t), sorted(noise))


@pytest.mark.parametrize("t", ["We ate (during lunch) there", "Please (bring more) tea", "It was (an introduction) then", "All *sharing* is good", "He said [the big one] fell", "So (we heard music all night) and left"])
def test_speech_in_brackets_stays(t):
    assert words(t) == t


@pytest.mark.parametrize("note", ["[MUSIC PLAYING]", "(phone ringing)", "*sighs*", "[door closes]", "(clears throat)", "[laughs and coughs]", "(sobbing)", "[UNTRANSCRIBED_AUDIO_1.0-2.0s_LOW_SIGNAL]", "[music " + "music " * 60 + "playing]", "[00:00:03]"])
def test_notes_go(note):
    assert words(f"So {note} we go") == "So we go"


def test_long_labels_and_notes(spark):
    far = "A" + "a" * 120
    rows = [(1, 0, f"{far} Roe: one. {far} Roe (host of the show, who also reads the news every day of the week): two", "x"), (1, 1, "Bo Lee: three", "x"), (1, None, "first", "x"), (1, None, "also first", "x"), (1, None, "first", "x")]
    got = sorted((r.turn_no, r.speaker, r.n_words) for r in turns.speaker_turns(spark.createDataFrame(rows, SEG)).collect())
    assert got == [(1, "unknown", 3), (2, f"{far.lower()} roe", 2), (3, "bo lee", 1)]
