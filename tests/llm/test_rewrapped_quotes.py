"""Quoted passages whose lines were broken anew."""

import textwrap

from rowmill.llm.quotes import link_quotes

FIRST = ("The committee met on Tuesday and agreed that the bridge should be painted green, although two of its members "
         "asked for blue and one did not care at all about the colour.")
SECOND = ("Nobody has yet explained who will pay for the paint, nor for the ladders that will be needed to reach "
          "the upper parts of the arch.")


def quote(text, width, mark="> "):
    return "\n".join(mark + line for line in textwrap.wrap(text, width))


def links(spark, texts):
    m = spark.createDataFrame([(1, k, "u", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    out = sorted(link_quotes(m).collect(), key=lambda r: r.turn)
    return [r.parent_turn for r in out], [r.path for r in out]


def test_rewrapped_passages_find_their_message(spark):
    texts = [f"{FIRST}\n\nRegards", textwrap.fill(SECOND, 50), f"{quote(FIRST, 40)}\nAgreed.",
             f"{quote(SECOND, 33)}\n>\n{quote(FIRST, 30, '> > ')}\nMe too", "Hi\nthere you", "> hi there you\nHello"]
    assert links(spark, texts) == ([None, None, 0, 1, None, 4], [[0], [1], [0, 2], [1, 3], [4], [4, 5]])


def test_part_of_a_passage_and_an_attribution(spark):
    part = " ".join(FIRST.split()[4:22])
    texts = [FIRST, SECOND, f"> Someone wrote:\n{quote(part, 35)}\nYes"]
    assert links(spark, texts)[0] == [None, None, 0]


def test_a_whole_line_beats_a_mention(spark):
    line = "I agree with the plan you made yesterday"
    texts = [line, f"As was said: {line.lower()}, or so.", f"> {line}\nFine", "> yesterday\nWhat?"]
    assert links(spark, texts)[0] == [None, None, 0, None]


def test_other_words_are_no_match(spark):
    other = " ".join(w if k % 4 else "xyz" for k, w in enumerate(FIRST.split()))
    assert links(spark, [FIRST, f"{quote(other, 40)}\nNo"])[0] == [None, None]


def test_message_that_holds_most_of_a_passage_wins(spark):
    both = f"{FIRST} {SECOND}"
    assert links(spark, [both, FIRST, quote(both, 44)])[0] == [None, None, 0]
