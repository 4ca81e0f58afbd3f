import random

from lensframe.llm import scans as S

WORDS = "pressure valve pump limit casing cement mud weight report sensor temperature formation drilling observed during night section planned inspection".split()


def corpus(n=80, seed=1):
    """Documents with known furniture, broken words and misread characters, and where they are."""
    rng = random.Random(seed)
    rows, truth = [], set()
    for d in range(n):
        pages = []
        for p in range(1, 4):
            lines = [f"Well report  -  {d}/1-A-2"]
            truth.add((d, p, 1, "header"))
            words = [rng.choice(WORDS) for _ in range(60)]
            for k in range(12):
                line = words[k * 5 : k * 5 + 5]
                no = len(lines) + 1
                if p > 1 and rng.random() < 0.06:
                    i = rng.randrange(5)
                    bad = line[i].replace("e", "c", 1) if "e" in line[i] else line[i].replace("o", "0", 1)
                    if bad != line[i]:
                        line[i] = bad
                        truth.add((d, p, no, "misread"))
                text = " ".join(line)
                lines.append(text)
                if k < 11 and rng.random() < 0.1:
                    w = rng.choice([x for x in WORDS if len(x) > 3])
                    lines[-1] += " " + w[:3] + "-"
                    words[k * 5 + 5] = w[3:]
                    truth.add((d, p, no, "hyphen"))
            lines += ["", f"        - {p} -"]
            truth.add((d, p, len(lines), "pageno"))
            pages.append(("\r\n" if d % 2 else "\n").join(lines))
        rows.append((d, f"well-report-{d}_1-A-2-00001.pdf", pages, 2))
    return rows, truth


COLS = "scan_id bigint, name string, pages array<string>, ocr_pages int, kind string"


def test_found_against_planted(spark):
    rows, truth = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows + rows[:3]], COLS)
    got = {tuple(r) for r in S.defects(S.learn(df)).collect()}
    for kind in ("header", "pageno", "hyphen", "misread"):
        a, b = {t for t in truth if t[3] == kind}, {t for t in got if t[3] == kind}
        assert len(a & b) >= 0.95 * len(a) and len(a & b) >= 0.95 * len(b), (kind, len(a), len(b), len(a & b))


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, None, None, None, None), (2, "a.pdf", [], 0, None), (3, "b.pdf", [None, "", " \n"], 1, None), (4, None, ["word " * 50_000], None, None)], COLS)
    assert S.defects(S.learn(df)).count() == 0
    assert S.defects(S.learn(df.limit(0))).count() == 0


def test_paragraphs(spark):
    rows, _ = corpus(40, 2)
    df = spark.createDataFrame([(*r, "x") for r in rows], COLS)
    text = " ".join(r.text for r in S.paragraphs(S.learn(df)).where("scan_id = 0").collect())
    assert "Well report" not in text and "- 1 -" not in text and set(text.split()) <= set(WORDS)


def test_glyphs_and_numbers():
    assert S.edits("before", "bef0re") == 1 and S.edits("drum", "driim") == 1 and S.edits("limestone", "hmestone") == 1 and S.edits("connection", "cormection") == 1 and S.edits("cat", "dog") is None
    assert all(S.fold(a) == S.fold(b) for a, b in (("before", "bef0re"), ("drum", "driim"), ("limestone", "hmestone"), ("connection", "cormection"), ("down", "dowri"), ("well", "wcll")))
    assert S.numeric_fix("3b30") == "##" and S.numeric_fix("l888.") == "##" and S.numeric_fix("3330") is None
    assert S.page_number("Page 3 of 7") == ("page", 3) and S.page_number("- l2 -") == ("b", 12) and S.page_number("xiv") == ("roman", 14) and S.page_number("the end") is None
    assert S.layer_pages(["a", None, "b", "c"], 1) == {1, 3} and S.layer_pages(["a"], None) == set()


def test_every_word_of_a_folded_spelling_may_be_the_right_one(spark):
    # all fold alike; glyph edits make '1ull' of 'lull' only, the least frequent of the words
    counts = {"bill": 900, "hill": 800, "bib": 700, "lull": 600, "1ull": 2, "b1ll": 2}
    assert len({S.fold(w) for w in counts}) == 1
    lexicon = S._with_fold(spark.createDataFrame([(w, n if n > 2 else 0, n) for w, n in counts.items()], "entry string, sure bigint, every bigint"))
    got = {r.entry: [(c.word, c.ratio) for c in r.choices] for r in S._corrections(lexicon).collect()}
    assert got["1ull"] == [("lull", 300.0)] and ("bill", 450.0) in got["b1ll"] and not {"bill", "hill", "bib", "lull"} & set(got)


FISH = "prisoner court judge release lawyer money jail sentence appeal hearing".split()
GAME = "player goal team kick field match coach score stadium referee".split()


def ambiguous(n=60, seed=3):
    """Pages in which 'ba1l' stands for 'bail' among words of courts and for 'ball' among words of games; nothing but the company tells."""
    rng = random.Random(seed)
    rows, truth = [], {}
    for d in range(n):
        topic, word = ((FISH, "bail"), (GAME, "ball"))[d % 2]
        pages = []
        for p in range(1, 4):
            lines = []
            for k in range(10):
                line = rng.sample(topic, 6)
                line.insert(3, word)
                if p == 3 and k == 4 and d % 10 < 2:
                    line[3] = "ba1l"
                    truth[d, p, k + 1] = word
                lines.append(" ".join(line))
            pages.append("\n".join(lines))
        rows.append((d, None, pages, 1, "x"))
    return rows, truth


def test_context_decides_and_shuffled_vectors_do_not(spark, monkeypatch):
    rows, truth = ambiguous()
    df = spark.createDataFrame(rows, COLS)

    def fixed(model):
        return {(r.scan_id, r.page_no, r.line_no): r.fixed for r in S.decide(model).where("kind = 'misread'").collect()}

    assert fixed(S.learn(df)) == truth and set(truth.values()) == {"bail", "ball"}
    real = S._vectors

    def shuffled(lines, lexicon):
        words, m = real(lines, lexicon)
        return words, m[list(random.Random(5).sample(range(len(m)), len(m)))] if len(m) else m

    def absent(lines, lexicon):
        return [], real(lines, lexicon)[1][:0]

    for without in (shuffled, absent):
        monkeypatch.setattr(S, "_vectors", without)
        assert fixed(S.learn(df)) != truth


def test_a_rare_word_of_other_company_is_no_misreading(spark):
    """'hail' could be a misread 'bail', but the words around it say that it is none; without vectors it would be one."""
    rng = random.Random(4)
    pages = [[" ".join([*rng.sample(topic, 3), word, *rng.sample(topic, 3)]) for _ in range(12)] for topic, word in [(FISH, "bail"), (GAME, "storm")] * 30]
    for i in (3, 5, 7, 9):
        pages[i + 2][4] = pages[i + 2][4].replace("storm", "hail")
    df = spark.createDataFrame([(d, None, ["\n".join(p)], 1, "x") for d, p in enumerate(pages)], COLS)
    model = S.learn(df)
    assert [r.entry for r in S._links(model.lexicon).where("entry = 'hail' and word = 'bail'").collect()] == ["hail"]
    assert S.decide(model).where("kind = 'misread'").count() == 0


def test_furniture_beyond_what_is_broadcast(spark, monkeypatch):
    rows, truth = corpus(60, 7)
    df = spark.createDataFrame([(*r, "x") for r in rows], COLS)
    want = {tuple(r) for r in S.defects(S.learn(df)).collect()}
    monkeypatch.setattr(S, "FURNITURE_SHARED", 0)
    assert {tuple(r) for r in S.defects(S.learn(df)).collect()} == want


def test_furniture_does_not_depend_on_the_other_documents(spark):
    """A footer of two dozen documents stays furniture among many others, and a long one too."""
    footer = "This sheet is the property of the operating company and must not be handed to others without its written consent in advance"
    rng = random.Random(9)
    make = lambda foot: "\n".join([" ".join(rng.choice(WORDS) for _ in range(6)) for _ in range(14)] + ([foot] if foot else []))
    for others in (20, 400):
        df = spark.createDataFrame([(d, None, [make(footer if d < 24 else None)], 0, "x") for d in range(24 + others)], COLS)
        assert S.defects(S.learn(df)).where("kind = 'header'").count() == 24
