import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import canonical, encoding, ocr, split, toxicity


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("ab ,.\n。，中文é"), max_size=2500), st.sampled_from([(500, 50), (100, 20), (60, 0)]))
def test_pieces_cover_the_text_within_the_limit(text, sizes):
    limit, overlap = sizes
    got = split.pieces(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(b - a <= limit for a, b in got)
    back = text[: got[0][1]]
    for (_, end), (a, b) in zip(got, got[1:]):
        assert a <= end and end - a <= overlap
        back += text[end:b]
    assert back == text


def test_pieces_end_at_the_strongest_boundary():
    text = "word " * 80 + "\n\n" + "word " * 60
    assert text[: split.pieces(text)[0][1]].endswith("\n\n")


def test_split_table(spark):
    rows = spark.createDataFrame([("t", "1", "x" * 501, "z"), ("t", "1", "x" * 501, "z"), ("t", "2", None, "z"), ("t", "3", "", "z"), ("t", "4", "y" * 500, "z")], "item_table string, item_key string, text string, piece_no string")
    got = split.split_oversized(rows).collect()
    assert {r["item_key"] for r in got} == {"1"} and len(got) == 2
    assert split.split_oversized(rows.limit(0)).count() == 0


@pytest.mark.parametrize(("a", "b"), [("Ａｂ１", "Ab1"), ("é", "é"), ("a​b", "ab"), ("a b", "a b"), ("са", "ca"), ("ﬁn", "fin"), ("⼈口", "人口"), ("co‐op", "co-op"), ("a　b", "a b"), ("a\r\nb", "a\nb"), ("so­ft", "soft")])
def test_same_look(a, b):
    assert canonical.canonical(a) == canonical.canonical(b)


@pytest.mark.parametrize(("a", "b"), [("é", "e"), ("A", "a"), ("1", "2"), ("國", "国"), ("x²", "x2"), ("a b", "ab"), ("a–b", "a-b"), ("½", "1/2")])
def test_other_look(a, b):
    assert canonical.canonical(a) != canonical.canonical(b)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_canonical_form_is_stable(text):
    once = canonical.canonical(text)
    assert canonical.canonical(once) == once


def test_same_look_pairs(spark):
    rows = spark.createDataFrame([(1, "abc"), (2, "аbc"), (3, "abc"), (4, None), (5, ""), (6, "​"), (1, "abc")], "id bigint, t string")
    got = {(r["key_a"], r["key_b"]) for r in canonical.same_look_pairs(rows, "id", "t").collect()}
    assert got == {(1, 2), (2, 3), (5, 6)}
    assert canonical.same_look_pairs(rows.limit(0), "id", "t").count() == 0


FRENCH = ["Les générateurs fertiles ont précédé les filtres mobiles à l'été.", "Les décrets étanches ont protégé la mémoire où le comité s'est réuni."]
CHINESE = ["季节性水库削弱了排班表，入库时间另行登记。", "颗粒状车间检查了访谈，因为标签缺失。"]
ENGLISH = ["The pump of the station was drained with a café in the naïve façade.", "The ledger of the terminal and the valve was long."]


@pytest.fixture(scope="module")
def model():
    return encoding.train([" ".join(random.Random(i).sample(x, 2)) for i in range(40) for x in (FRENCH, CHINESE, ENGLISH)])


def test_the_alphabet_is_that_of_all_rows(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate((FRENCH[0], CHINESE[0], ENGLISH[0]) * 20)], "id bigint, t string")
    got = encoding.train_on(rows, "id", "t", sample_rows=1).alphabet
    assert got >= set(FRENCH[0]) | set(CHINESE[0]) | set(ENGLISH[0])


@pytest.mark.parametrize("text", [FRENCH[0], CHINESE[0]])
@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp437", "mac_roman"])
def test_garbled_utf8_is_restored(model, text, wrong):
    try:
        bad = text.encode().decode(wrong)
    except UnicodeDecodeError:
        pytest.skip("the encoding has no such characters")
    assert encoding.restore(bad, model)[0] == text


def test_garbled_twice_and_other_chains(model):
    twice = FRENCH[0].encode().decode("latin-1").encode().decode("latin-1")
    assert encoding.restore(twice, model)[0] == FRENCH[0]
    assert encoding.restore(CHINESE[0].encode("gbk").decode("latin-1"), model)[0] == CHINESE[0]
    assert encoding.restore("x � y", model)[1] == ["lost"]


@pytest.mark.parametrize("text", [*FRENCH, *CHINESE, *ENGLISH, "Журнал станции хранится в сухом помещении.", "A RECUPERAÇÃO DA ESTAÇÃO", "Prześlij źródło i próbkę", "Αθήνα και Πάτρα", "측정값은 다시 확인", "", None, "plain"])
def test_sound_text_is_left_alone(model, text):
    assert encoding.restore(text, model) is None


PAGE = "Faded Index / PH-12345\nThe glossary of the stable estuary simplified the harv-\nest at a rate of units per hour and then the pump of the\nstati0n was drained by the reliable committee in the even-\ning before the doors were sealed for a well-\nknown reason and the committee of the station left TH-\n4412 alone.\nPage 3 of 9"


def language():
    words = re.findall(r"[^\W\d_]+", PAGE.lower().replace("stati0n", "station")) + ["harvest", "evening", "station"]
    return ocr.Language({w: 500 for w in words}, {}, {}, 20_000, 0, {"0": [("o", -4.0)], "1": [("i", -4.0)], "c": [("e", -4.0)]}, {}, {"Aa Aa / A-#": "header"})


def test_scanned_page():
    found, body = ocr.examine(PAGE, language())
    assert sorted(found) == [(1, "header"), (2, "hyphen"), (4, "hyphen"), (4, "misread"), (5, "hyphen"), (8, "page_number")]
    text = ocr.paragraphs(body)
    assert "harvest at" in text and "station was" in text and "Page" not in text and "Index" not in text


@pytest.mark.parametrize("line", ["- 12 -", "[4]", "—77—", "· 4 ·", "第 3 页", "第3页 共9页", "p. l2", "Page 3 of 9", "42", "iv"])
def test_page_numbers(line):
    assert ocr.layout([line], {}, {}) == ["page_number"]


def test_page_numbers_of_any_style_count_on():
    body = ["The glossary of the estuary and the pump of the station was drained"] * 8
    edges = {k: ocr.edge_lines([*body, f"Blatt <{40 + k}>"]) for k in (-1, 1, 2)}
    assert ocr.layout([*body, "Blatt <40>"], {}, edges)[-1] == "page_number"
    assert ocr.layout([*body, "B1att <40>"], {}, edges)[-1] == "page_number"
    assert ocr.layout([*body, "Blatt <57>"], {}, edges)[-1] == "body"
    assert ocr.layout([*body, "was drained at", "80", "Blatt <40>"], {}, edges)[-2] == "body"


@pytest.mark.parametrize(("number", "n"), [("l2", 12), ("5O", 50), ("xiv", 14), ("IX", 9), ("十二", 12), ("二百三十", 230), ("二〇", 20)])
def test_numerals(number, n):
    assert ocr.value(number) == n


def test_digital_text_is_not_scanned():
    assert not ocr.scanned(["a long paragraph " * 20, "", "another " * 30])
    assert not ocr.scanned([""])


def test_suspended_compounds_are_not_cut():
    lang = language()
    assert not ocr.cut_word("alle Vor-", "und Nachteile", lang) and ocr.cut_word("die Mem-", "branen", lang) and not ocr.cut_word("die Mem-", None, lang)
    assert ocr.cut_word("the harv=", "est", lang) and not ocr.cut_word("the pump=", "est", lang)


def test_each_line_is_not_looked_at_anew(monkeypatch):
    """Lines of Han text have no words to take apart, and lines of text no style of a page number."""
    looked = Counter()
    for name in ("word_parts", "style"):
        of = getattr(ocr, name)
        monkeypatch.setattr(ocr, name, lambda x, of=of, name=name: looked.update([name]) or of(x))
    lang = language()
    for i in range(200):
        ocr.decode_words(chr(0x5000 + i) + "站的泵在雨季之前已经排空，并由委员会复核" + chr(0x6000 + i), lang)
        ocr.layout(["the reliable committee of the station was drained"] * 5 + [f"the pump {i} of the station was sealed before noon"], {}, {})
    assert looked["word_parts"] == 0 and looked["style"] == 0


@given(st.text(st.sampled_from("aBlO|iIvx19 -页第站的泵在雨季二十零〇é\u00a0#.\t"), max_size=24))
def test_lines_that_may_be_page_numbers(line):
    assert ocr.numbering(line) == ocr.numbered(ocr.style(line))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("abB1 .,;泵站，一\n\r\t\u00a0é-😀"), max_size=20), max_size=6))
def test_counts_of_texts(texts):
    want = Counter()
    for t in texts:
        for line in t.split("\n"):
            line = re.sub("[0-9A-Za-z]", "0", line.strip())
            want.update(("h", a + b) for a, b in zip(line, line[1:]) if ocr.HAN.search(line))
        found = ocr.WORD.findall(re.sub("[1-9]", "0", t.lower()))
        want.update([*(("w", x) for x in found), *(("p", a + " " + b) for a, b in zip(found, found[1:]))])
    seen, got = ocr.Tally(), Counter()
    for n, t in enumerate(texts):
        seen.add(t)
        if n % 3 == 1:
            seen.count()
        if n % 4 == 3:
            got.update({(r["kind"], r["key"]): r["n"] for b in [*_counted(seen)] for r in b.to_pylist()})
    got.update({(r["kind"], r["key"]): r["n"] for b in [*_counted(seen)] for r in b.to_pylist()})
    assert got == want


def _counted(seen):
    seen.count()
    return seen.flush()


@given(st.lists(st.text(st.sampled_from("泵站的，。 a1\n"), max_size=12), max_size=4))
def test_han_that_may_be_misread(texts):
    """As by the definition: a character between rare pairs, of which another would make frequent ones."""
    lang = ocr.Language({}, {}, {"泵站": 5000, "站的": 4000, "的泵": 90, "泵的": 200, "站，": 3000, "，泵": 2500, "a的": 9, "0站": 2000}, 0)
    eye, count = ocr.Observer(lang), lambda x: lang.han.get(x, 0)
    for t in texts:
        want = []
        for line in t.split("\n"):
            s = re.sub("[0-9A-Za-z]", "0", line.strip())
            for a, c, b in zip(s, s[1:], s[2:]):
                if ocr.HAN.search(s) and count(a + c) < eye.rare and count(c + b) < eye.rare and c != "0":
                    fit = [x for x in "泵站的，。" if count(a + x) >= 20 * max(1, count(a + c)) and count(x + b) >= 20 * max(1, count(c + b))]
                    want += [(x, c, a + b) for x in fit if x != c]
        assert sorted(e[1:] for e, _ in eye.of_han(t)) == sorted(want)


RECORD = "record_table string, record_id bigint, file_path string, page_num int, text string"


def test_defects_over_pages(spark):
    def page(n, last):
        return "\n".join([f"The {w} committee {n} of the {w} station was drained" for w in ("reliable", "stable", "narrow", "hollow", "porous")] + [last])

    data = [("loaded_pages", 1, "f", 1, page(1, "the cart-")), ("loaded_pages", 2, "f", 2, "ridge " + page(2, "the term-")), ("loaded_pages", 3, "g", 1, None), ("loaded_pages", 4, "g", 2, ""), ("loaded_pages", 1, "f", 1, page(1, "the cart-")), ("cleaning_results", 5, None, None, page(1, "the cart-"))]
    rows = spark.createDataFrame(data, RECORD)
    pages = ocr.scanned_pages(rows)
    got = {tuple(r) for r in ocr.defects(pages, ocr.train(rows, pages)).collect()}
    assert got == {("loaded_pages", 1, 6, "hyphen")}
    none = ocr.scanned_pages(rows.limit(0))
    assert ocr.defects(none, ocr.train(rows.limit(0), none)).count() == 0


def test_words_cut_between_pages_are_joined(spark):
    def page(first, last):
        return "\n".join([first, *["the reliable committee of the station was drained"] * 4, "the pump of the " + first[:6] + " glossary rests", last])

    data = [("loaded_pages", 1, "f", 1, page("the glossary of the estuary and the pump", "simplified the harv-")), ("loaded_pages", 2, "f", 2, page("est, at a rate of units per hour and then", "before the even-")), ("loaded_pages", 3, "f", 3, "Page 3 of 9\n" + page("1ng the doors were sealed for a reason", "and the even-")), ("loaded_pages", 4, "f", 5, page("ing of the station was left alone by it", "the committee")), ("loaded_pages", 5, "g", 1, page("the glossary of the estuary and the pump", "simplified the harv-")), ("loaded_pages", 6, "g", 2, page("cst at a rate of units per hour and then", "the committee"))]
    rows = spark.createDataFrame([*data, data[0]], RECORD)
    got = {r["record_id"]: r["text"] for r in ocr.repaired(ocr.scanned_pages(rows), language()).collect()}
    assert got[1].endswith("simplified the harvest,") and got[2].startswith("at a rate")
    assert got[3].endswith("the even-") and got[4].startswith("ing of")
    assert got[5].endswith("simplified the harvest") and got[6].startswith("at a rate")


def planted(seed=4, files=12, pages=10):
    """Pages with noise of other kinds than the tables have: (rows, true defects)."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("bdfgklmnprstvw") + rnd.choice("aeiou") for _ in range(rnd.randint(2, 5))) for _ in range(300)]
    han = ["".join(chr(rnd.randint(0x5000, 0x5200)) for _ in range(rnd.randint(2, 4))) for _ in range(150)]
    confused, shapes = [("g", "q"), ("k", "lc"), ("w", "\u03c9"), ("d", "ð")], [(w[0], "\u7c73") for w in han[:2]]
    rows, true, rid = [], set(), 0
    for f in range(files):
        zh = f % 3 == 2
        title = "".join(rnd.sample(han, 3)) if zh else " ".join(w.title() for w in rnd.sample(vocabulary, 3))
        for p in range(pages):
            rid += 1
            lines = [title if rnd.random() < 0.8 else title.replace(title[2], "#", 1)]
            defects = {(1, "header")}
            for n in range(14):
                line, bad = "", False
                while len(line) < (28 if zh else 60):
                    w = rnd.choice(han if zh else vocabulary)
                    if rnd.random() < 0.03:
                        new = w
                        for a, b in shapes if zh else confused:
                            if a in w:
                                new = w.replace(a, b, 1)
                                break
                        bad, w = bad or new != w, new
                    line += w + ("，" if zh and rnd.random() < 0.2 else "" if zh else " ")
                if not zh and n < 13 and rnd.random() < 0.3:
                    w = rnd.choice(vocabulary)
                    lines.append(line + w[:2] + "‐")
                    defects.add((len(lines), "hyphen"))
                    rest = w[2:] + " "
                else:
                    lines.append(line.strip())
                    rest = ""
                if bad:
                    defects.add((len(lines), "misread"))
                if rest:
                    lines.append(rest + rnd.choice(vocabulary) + " " + " ".join(rnd.sample(vocabulary, 6)))
            lines.append(f"≡ Blatt {p + 31} ≡" if f % 2 else f"<{p + 7}>")
            defects.add((len(lines), "page_number"))
            rows.append(("loaded_pages", rid, f"f{f}", p, "\n".join(lines)))
            true |= {("loaded_pages", rid, n, d) for n, d in defects}
    return rows, true


def test_noise_of_other_kinds(spark):
    rows, true = planted()
    records = spark.createDataFrame(rows, RECORD)
    pages = ocr.scanned_pages(records)
    got = {tuple(r) for r in ocr.defects(pages, ocr.train(records, pages)).collect()}
    for kind, least in (("header", 0.97), ("page_number", 0.97), ("hyphen", 0.97), ("misread", 0.9)):
        want, found = {x for x in true if x[3] == kind}, {x for x in got if x[3] == kind}
        assert len(want & found) >= least * len(want), kind
        assert len(want & found) >= 0.9 * len(found), kind


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=25))
def test_segments_are_the_maximal_ones(scores):
    def cut(a, b):
        """Maximal segments by the definition: the best of a range, then of what is left on either side."""
        best = max(((sum(scores[i:j]), -(j - i), -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        i = -best[2]
        j = i - best[1]
        return [*cut(a, i), (i, j, best[0]), *cut(j, b)]

    got = toxicity.segments([float(x) for x in scores])
    assert sum(s for _, _, s in got) == sum(s for _, _, s in cut(0, len(scores)))
    assert all(b <= c for (_, b, _), (c, _, _) in zip(got, got[1:]))


def test_spellings():
    assert "asshole" in toxicity.plain("you A.S.S.H.O.L.E !") and "idiot" in toxicity.plain("1d10t") and "混蛋" in toxicity.plain("混*蛋")
    assert "mass balance" in toxicity.plain("Assess the mass balance")


CALLED = ["白痴", "人渣", "王八蛋", "idiot", "connard", "salaud ordure", "a白", "渣 b", "白 a", "ab白", "白 ab", "a b ab", "痴 a白"]


def brute(text, wanted):
    """Tokens by walking the sentences of the tokenizer."""
    return Counter(t for words in toxicity.sentences(text) for ts in toxicity.tokens(words) for t in ts if t in wanted)


@pytest.mark.parametrize(("text", "token"), [("白 痴", "白痴"), ("白·痴", "白痴"), ("白-痴", "白痴"), ("白_痴", "白痴"), ("白、痴", "白痴"), ("王\u3000八 - 蛋", "王八蛋"), ("connard\u00a0!", "connard"), ("你idiot啊", "idiot"), ("[idiot] [moron]", "moron"), ("#idiot #moron", "idiot"), ("_idiot_ _moron_", "idiot moron"), ("idiot\rmoron", "idiot moron"), ("idiot2", "idiot"), ("a白痴", "a白"), ("ab 白", "ab白"), ("白a", "白 a")])
def test_spellings_are_met(text, token):
    assert [t for _, t in toxicity.Matcher({token}).hits(toxicity.joined(text))] == [token]
    assert brute(text, {token}) == {token: 1}


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab白痴渣한글 .、·-_'’*[2\n\u00a0!,‹\t"), max_size=14), st.sets(st.sampled_from(CALLED), max_size=4))
def test_the_matcher_meets_the_tokens_of_the_sentences(text, wanted):
    t = toxicity.plain(text)
    matcher = toxicity.Matcher(wanted)
    assert Counter(x for _, x in matcher.hits(toxicity.joined(t))) == brute(t, wanted)
    full = [w for w in toxicity.sentences(t) if any(x in wanted for ts in toxicity.tokens(w) for x in ts)]
    strip = lambda words: "\0".join(words).strip("\0,").split("\0")
    assert [strip(w) for w in matcher.sentences(t)] == [strip(w) for w in full]
    scorer = toxicity.Scorer({k: dict.fromkeys(wanted, 5.0) for k in toxicity.MODELS}, dict.fromkeys(toxicity.MODELS, 1.0))
    whole = scorer.score(text)
    scorer.calls = matcher
    assert scorer.score(text) == whole


OTHER = ["글", "글白", "白 글", "a 글", "글 a", "한글", "白글白", "글a白", "идиот", "ты идиот", "글,한"]


@pytest.mark.parametrize(("text", "token"), [("글白a", "글"), ("글白a", "글白"), ("白글a", "白 글"), ("ты, идиот!", "идиот"), ("ты · идиот", "ты идиот"), ("a 글.", "a 글"), ("白, 글 白", "글白")])
def test_words_of_other_scripts_are_met(text, token):
    assert [t for _, t in toxicity.Matcher({token}).hits(toxicity.joined(text))] == [token]
    assert brute(text, {token}) == {token: 1}


@settings(max_examples=600, deadline=None)
@given(st.text(st.sampled_from("ab白痴한글идиоты .、·-_'’2\n\u00a0!,‹\t"), max_size=14), st.sets(st.sampled_from([*OTHER, *(x for x in CALLED if x != "ab白")]), max_size=6))
def test_the_matcher_meets_the_tokens_of_all_scripts(text, wanted):
    t = toxicity.plain(text)
    matcher = toxicity.Matcher(wanted)
    assert Counter(x for _, x in matcher.hits(toxicity.joined(t))) == brute(t, wanted)
    full = [w for w in toxicity.sentences(t) if any(x in wanted for ts in toxicity.tokens(w) for x in ts)]
    strip = lambda words: "\0".join(words).strip("\0,").split("\0")
    assert [strip(w) for w in matcher.sentences(t)] == [strip(w) for w in full]
    scorer = toxicity.Scorer({k: dict.fromkeys(wanted, 5.0) for k in toxicity.MODELS}, dict.fromkeys(toxicity.MODELS, 1.0))
    whole = scorer.score(text)
    scorer.calls = matcher
    assert scorer.score(text) == whole


def test_toxic_documents(spark):
    rnd = random.Random(4)
    harmless = ["The pump was drained.", "The valve of the station closed.", "The idiot-proof connector fits.", "A glossary was updated."]
    toxic = ["Go to hell, you bastard, you idiot!", "Shut up, moron, you pathetic loser.", "Get lost, you scumbag and moron."]
    docs, labels = [], []
    for i in range(1500):
        bad = i % 50 == 0
        docs.append((i, " ".join([rnd.choice(harmless) for _ in range(30)] + [rnd.choice(toxic)] * bad)))
        if i < 750:
            labels.append((i, "r", int(bad), 0, 0))
    docs += [(9000, ""), (9001, None)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    l = spark.createDataFrame(labels, "doc_id bigint, rater string, is_abusive int, is_hateful int, is_sexual int")
    found = {r["doc_id"] for r in toxicity.flagged(toxicity.scored(d, toxicity.train(d, l))).where("found").collect()}
    held_out = set(range(750, 1500))
    assert found & held_out == {i for i in held_out if i % 50 == 0}
    assert toxicity.train(d, l.limit(0)).score("You idiot")["hateful"] == 0
