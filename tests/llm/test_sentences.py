import pytest

from normgraph.llm.sentences import sentence_spans, sentence_units
from tests.conftest import rows

CASES = [
    ["The Chair spoke.", "Dr. A. B. Movuto et al. agreed to Art. 5(2), No. 7 e.g. at 5.30 p.m. on Monday.", "The seat was held by X & Y Ltd.", "It closed at 4 a.m."],
    ["“We cannot accept this. We abstain,” said the delegate.", "“The matter is closed.”", "The Chair asked: “Any objection?” and heard none.", '"No. Not now," replied Ms. X.'],
    ["(See also Art. 7, No. 3.)", "The text covers fees, levies, etc.", "Was it met?", "So ordered!", "It is at https://docs.x.example/v7.52 […].", "The proposal … lapsed."],
    ["Der Ausschuss billigt 5,1 v. H. z. B. bei Gefahr.", "Er tagt am 8. März 2002.", "„Das geht nicht. Wir gehen“, sagte sie.", "Die Vorlage umfasst Gebühren usw.", "Die Frist gilt."],
    ["La présidence demanda : « Qui s'y oppose ? » sans réponse.", "« Le point est clos. »", "M. X conteste l'art. 32, al. 9 p. ex. en cas d'urgence."],
    ["«El punto queda cerrado.»", "¿Se alcanzó?", "¡Aprobado!", "La Sra. P. Gewupe examina el art. 39, párr. 8."],
    ["Заседание прошло в 2022 г.", "Комитет принял до 7 мая 1998 г. включительно.", "Текст касается сборов и т. д.", "Г-н Л. Иванов ушёл.", "Председатель спросил: «Есть возражения?» — и ушёл."],
    ["Υπάρχει απαρτία 8,6 %;", "Ο κ. Γωμολε ήρθε στις 4.30 μ.μ. ακριβώς.", "Το κείμενο αφορά τέλη κ.λπ.", "Η επιτροπή έκλεισε."],
    ["قال وفد: «لا نقبل. نمتنع عن التصويت» ثم انصرف.", "د. لوتوها تعدل ص. 145 من التقرير.", "هل اكتمل النصاب؟", "تمت الموافقة!"],
    ["डॉ. गुचोसे अनु. 163 के अधीन पृ. 4 को टालती है।", "कौन विरोध करता है?", "वह ने कहा, “हम सहमत नहीं। हम जा रहे हैं,” और सभा छोड़ दी।"],
]


def units(text):
    return [text[a:b] for a, b in sentence_spans(text)]


@pytest.mark.parametrize("want", CASES)
@pytest.mark.parametrize("gap", [" ", "\n\n", "\t"])
def test_spaced_scripts(want, gap):
    assert units(gap.join(want)) == want


@pytest.mark.parametrize("want", [
    ["工作组修改了运输规则，见附件7。", "“我们不能接受。我们弃权。”Davode代表说。", "主席问：“有异议吗？”无人回答。", "提案……已失效。", "是否达到37.9%的法定人数？", "通过！"],
    ["代表は「受け入れられない。棄権する。」と述べた。", "議長が「異議はあるか？」と尋ねた。", "提案は……失効した。", "可決！"],
])
def test_unspaced_scripts(want):
    assert units("".join(want)) == want


def test_thai():
    want = ["คณะทำงานแก้ไขกำหนดเวลา 160 วัน", "กฎการขนส่งต่าง ๆ ของรัฐ", "ประธานรับรอง"]
    assert units(" ".join(want)) == want


def test_lines():
    want = ["CHAPTER IV", "Article 5", "The Committee decides on:", "(a) the levy;", "2.103 the index", "– the list", "2. Agenda", "The text has no end", "It goes on."]
    assert units("\n".join(want[:6]) + "\n\n" + "\n".join(want[6:])) == want
    assert units("\r\n".join(want[:6]) + "\r\n \r\n" + "\r\n".join(want[6:])) == want
    assert units("closed at noon.The next began.He left") == ["closed at noon.", "The next began.", "He left"]
    assert units("under any\nwaiver of Mr.\nGilachi. It ended") == ["under any\nwaiver of Mr.\nGilachi.", "It ended"]


def test_wrapped():
    text = "The delegation of Choshipu noted the report on records of puviko processing and of the Council. Prof. N. Piheda withdrew the list of gesanu substances in accordance with Art. 111(6) at noon. The seat was held by Sufaka & Jochabu Ltd. The presiding officer asked for clarification of the budget of 102,857 crowns."
    out, line = [], ""
    for w in text.split(" "):
        line = f"{line} {w}".strip()
        if len(line) >= 40:
            out.append(line)
            line = ""
    wrapped = "\n".join([*out, line])
    assert [u.replace("\n", " ") for u in units(wrapped)] == units(text) and len(units(text)) == 4


def test_all_text_is_covered():
    for text in ["“open quote. Never closed. And on", "a ) b ( c. D", "...", "?!", "x" * 50_000 + ". Y", " ​.   A. ", "A. B", '" " " . X', "1. 2. 3. 4."]:
        at = 0
        for a, b in sentence_spans(text):
            assert a >= at and text[at:a].strip() == "" and a < b and not text[a].isspace() and not text[b - 1].isspace()
            at = b
        assert text[at:].strip() == ""


def test_rows(spark):
    df = spark.createDataFrame([(1, "One. Two.", 0), (2, None, 0), (3, "", 0), (4, " \n ", 0), (None, "One.", 0), (1, "One. Two.", 0)], "doc_id long, text string, unit_start int")
    assert rows(sentence_units(df)) == sorted([(1, 0, 4), (1, 5, 9)] * 2 + [(None, 0, 4)], key=str)
    assert sentence_units(df.limit(0)).count() == 0


def test_spans_reach_over_any_number_of_line_ends():
    # no cut is forced after 24 poor ends: the cuts are those of the programme that looks back to the start
    text = '12 cases text of the\nAlpha beta long words of a longer and longer line that holds more\n12 cases text of the\n12 cases text of the\n12 cases words that go on\nAlpha beta text of the\nAlpha beta A\nAlpha beta words that go on\nAlpha beta text of the\n12 cases text of the\nAlpha beta A\n12 cases words that go on\n12 cases words that go on\n12 cases A\n12 cases words that go on\n12 cases text of the\n12 cases A\nAlpha beta text of the\nAlpha beta A\nAlpha beta A\nAlpha beta A\nAlpha beta words that go on\nAlpha beta long words of a longer and longer line that holds more\n12 cases A\nAlpha beta long words of a longer and longer line that holds more\nAlpha beta long words of a longer and longer line that holds more\n12 cases long words of a longer and longer line that holds more\n12 cases long words of a longer and longer line that holds more\n12 cases text of the\n12 cases text of the\nAlpha beta words that go on\n12 cases A\n12 cases long words of a longer and longer line that holds more\nAlpha beta text of the\nAlpha beta words that go on\nAlpha beta long words of a longer and longer line that holds more\n12 cases words that go on\n12 cases text of the\nAlpha beta words that go on.'
    assert sentence_spans(text) == [(0, 629), (630, 968), (969, 1161)]


def test_a_quotation_of_any_length_is_part_of_its_sentence():
    for n in range(1, 41):
        for opening, closing in ("“”", "„“", "«»", '""', "()"):
            inner = " ".join(f"Sentence number {k} is here." for k in range(n)) + " The last one goes,"
            text = f"First comes this. {opening}{inner}{closing} said the delegate. Then more was said."
            assert units(text) == ["First comes this.", f"{opening}{inner}{closing} said the delegate.", "Then more was said."], (n, opening)
        for text in (
            "主席说：「" + "".join(f"第{k}句话在这里。" for k in range(n)) + "」代表们同意了。",
            "Председатель сказал: «" + " ".join(f"Это фраза номер {k} тут." for k in range(n)) + "», и все согласились.",
            "Ο πρόεδρος είπε: «" + " ".join(f"Αυτή είναι η φράση {k} εδώ." for k in range(n)) + "» και όλοι συμφώνησαν.",
        ):
            assert units(text) == [text]


def test_a_quotation_that_nothing_closes_does_not_hold_sentences_together():
    assert units('He said "this. Then he left. Nobody came.') == ['He said "this.', "Then he left.", "Nobody came."]


def test_long_units_without_an_end():
    text = "\n".join(f"{k} of the entries that go on" for k in range(200))
    assert len(units(text)) in (1, 200) and len(units("word " * 3000 + "end. Next one.")) == 2
