import pytest

from lensframe.llm.sentences import spans, split_sentences


def units(text):
    return [" ".join(text[a:b].split()) for a, b in spans(text)]


@pytest.mark.parametrize(
    "text,want",
    [
        ("", []), (None, []), (" \n\t ", []), ("One. Two! Three?", ["One.", "Two!", "Three?"]),
        ("Drilled 6 in. hole from 3.5 m. The next, e.g. tomorrow, by Mr. A. B. Smith.", ["Drilled 6 in. hole from 3.5 m.", "The next, e.g. tomorrow, by Mr. A. B. Smith."]),
        ('He wrote "It stopped. Go on." in the note. Done.', ['He wrote "It stopped. Go on." in the note.', "Done."]),
        ('He said: "Clean." Then more.', ['He said: "Clean."', "Then more."]), ('"Stop!" the man called. Next', ['"Stop!" the man called.', "Next"]),
        ("Was it? (See Sec. 2.1 for more.) Yes (incl. 5 min. off). End", ["Was it?", "(See Sec. 2.1 for more.)", "Yes (incl. 5 min. off).", "End"]),
        ("Wait... the crane stopped. It ended... The end", ["Wait... the crane stopped.", "It ended...", "The end"]),
        ("Tested for 15 min. The yard in the U.S. Next it ran.It stopped.", ["Tested for 15 min.", "The yard in the U.S.", "Next it ran.", "It stopped."]),
        ("Die Pumpe fiel am 9. März um 12 Uhr, d. h. spät, z. B. heute aus usw. Die Probe kam.", ["Die Pumpe fiel am 9. März um 12 Uhr, d. h. spät, z. B. heute aus usw.", "Die Probe kam."]),
        ("Pumpen stoppet kl. 13.45 pga. lavt trykk den 3. mai. brønnen ble stengt.", ["Pumpen stoppet kl. 13.45 pga. lavt trykk den 3. mai.", "brønnen ble stengt."]),
        ("« Arrêtez ! » a crié le foreur. Le puits, p. ex. profond, ferme ! La vanne", ["« Arrêtez ! » a crié le foreur.", "Le puits, p. ex. profond, ferme !", "La vanne"]),
        ("司钻喊道：“停泵！”循环一周。他写着“好。走。”并签字。", ["司钻喊道：“停泵！”", "循环一周。", "他写着“好。走。”并签字。"]), ("彼は「止めろ。今だ。」と叫んだ。次へ。", ["彼は「止めろ。今だ。」と叫んだ。", "次へ。"]),
        ("पंप बंद हो गया। क्यों? डॉ. राम आए।", ["पंप बंद हो गया।", "क्यों?", "डॉ. राम आए।"]), ("لماذا؟ كتب «توقفت. نواصل.» في السجل. انتهى", ["لماذا؟", "كتب «توقفت. نواصل.» في السجل.", "انتهى"]),
        ("т. е. около 5 л/мин. Потери в 2018 г. по плану. «Стоп!» — крикнул он. Да", ["т. е. около 5 л/мин.", "Потери в 2018 г. по плану.", "«Стоп!» — крикнул он.", "Да"]),
        ("ปั๊มหยุดทำงานเวลา 05.30 น. เพราะแรงดันต่ำ หลุม 3 ถึงความลึก 5 เมตร (ดูรูปที่ 1)", ["ปั๊มหยุดทำงานเวลา 05.30 น. เพราะแรงดันต่ำ", "หลุม 3 ถึงความลึก 5 เมตร (ดูรูปที่ 1)"]),
        ("Heading\n\nwrapped\nprose here. And\nmore", ["Heading", "wrapped prose here.", "And more"]),
        ("1. Close it. Verify.\n2. Open\n\n- a\n- b", ["1. Close it.", "Verify.", "2. Open", "- a", "- b"]),
        ("05.45 WOW, wind 5 kn. from NW\n12-PT-1 | 5.0 bar | ok\n06:00 Circ. BU", ["05.45 WOW, wind 5 kn. from NW", "12-PT-1 | 5.0 bar | ok", "06:00 Circ. BU"]),
        ("See survey.v1.las. THE TEMP. SENSOR IN THE U.K. YARD FAILED. Next", ["See survey.v1.las.", "THE TEMP. SENSOR IN THE U.K. YARD FAILED.", "Next"]),
        ("An open \" quote. And more. (never closed. Still", ['An open " quote.', "And more.", "(never closed.", "Still"]),
    ],
)
def test_cases(text, want):
    assert units(text) == want


def test_cover_without_overlap():
    import random

    rng = random.Random(1)
    parts = ["Hello there", ".", "...", "!", '"', "(", ")", " ", "\n", "\n\n", "e.g.", "。", "“", "”", "«", "»", "5.5", "A.", "- x", "|", "？", "　", "\xa0", "ก", "\r\n"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        at = 0
        for a, b in spans(t):
            assert a >= at and b > a and not t[at:a].strip() and not t[a].isspace() and not t[b - 1].isspace()
            at = b
        assert not t[at:].strip()


def test_rows(spark):
    long = "A sentence with words. " * 40_000
    df = spark.createDataFrame([(1, "a. B c.", "x"), (2, None, "x"), (3, "  ", None), (4, long, "x")], "doc_id bigint, text string, sent_start string")
    out = split_sentences(df, "doc_id")
    assert out.where("doc_id < 4").count() == len(spans("a. B c.")) and out.where("doc_id = 4").count() == 40_000
    assert split_sentences(df.limit(0), "doc_id").count() == 0


@pytest.mark.parametrize(
    "text,want",
    [
        ("Actions:\n- Close it\n- Open it", ["Actions:", "- Close it", "- Open it"]), ("Plan\n1. Close it. Verify\nagain.\n2. Open", ["Plan", "1. Close it.", "Verify again.", "2. Open"]),
        ("# Log\n05.45 WOW\n06:00 Circ. BU", ["# Log", "05.45 WOW", "06:00 Circ. BU"]), ("Rates of the\nday\na | 5.0 | ok\nb | 6.0 | ok", ["Rates of the day", "a | 5.0 | ok", "b | 6.0 | ok"]),
        ("It was wrapped. See\n- Close it\nby hand.", ["It was wrapped.", "See - Close it by hand."]), ("Die Pumpe fiel am\n9. März aus. Die\nProbe kam.", ["Die Pumpe fiel am 9. März aus.", "Die Probe kam."]),
        ("Note this.\n- Close it", ["Note this.", "- Close it"]),
    ],
)
def test_lines_that_stand_for_themselves_after_prose(text, want):
    assert units(text) == want


@pytest.mark.parametrize("pair", ['""', "()", "“”", "““", "„“", "„”", "«»", "「」"])
def test_a_quotation_of_any_length_is_one_unit(pair):
    inner = "It stopped. " * 400 + "Go on."
    assert units(f"He wrote {pair[0]}{inner}{pair[1]} in the note. Done.") == [f"He wrote {pair[0]}{inner}{pair[1]} in the note.", "Done."]


def test_many_openers_without_closers_take_linear_time():
    import time

    began = time.time()
    spans('a (b "c «d „e “f ' * 30_000)
    assert time.time() - began < 20
