import time

import pytest

from corvane.llm import sentences as S

CASES = {
    "We stop. You go. It ends": ["We stop.", "You go.", "It ends"],
    "Dr. Ost vs. Prof. Pell is here. No. 46 of the list, e.g. this one, etc. We go.": ["Dr. Ost vs. Prof. Pell is here.", "No. 46 of the list, e.g. this one, etc.", "We go."],
    "It must read before 8 a.m. A file stays. At 5 p.m. UTC Vel Inc. scores it.": ["It must read before 8 a.m.", "A file stays.", "At 5 p.m. UTC Vel Inc. scores it."],
    "A. Tal and T. J. Elm use the U.S. mirror. Next.": ["A. Tal and T. J. Elm use the U.S. mirror.", "Next."],
    '"Never rotate it. It stops twice," said the note. It asks "Which one?" and then goes.': ['"Never rotate it. It stops twice," said the note.', 'It asks "Which one?" and then goes.'],
    "It works. (Node.js 24.x does as well.) Wait ... it works again?! Fine.": ["It works.", "(Node.js 24.x does as well.)", "Wait ... it works again?!", "Fine."],
    "Open config.json now. .NET and C# clients grew to 3.8 GB in v6.19.2. Done.": ["Open config.json now.", ".NET and C# clients grew to 3.8 GB in v6.19.2.", "Done."],
    "We move it out.The next one\nwraps here. Last 🙂\nNew one.": ["We move it out.", "The next one\nwraps here.", "Last 🙂", "New one."],
    "Am 18. Juni sperrt Hr. Dr. Ulm die Abfrage Nr. 69. Ca. 1.421 Zeilen usw. warten.": ["Am 18. Juni sperrt Hr. Dr. Ulm die Abfrage Nr. 69.", "Ca. 1.421 Zeilen usw. warten."],
    "« La limite est pleine. Attendez ! » répète Torne. Arrêtez la copie ! Fin.": ["« La limite est pleine. Attendez ! » répète Torne.", "Arrêtez la copie !", "Fin."],
    "В 2018 г. папка растёт (см. рис. 8). «Папка заполнена. Ждите», — пишет Wex. Конец.": ["В 2018 г. папка растёт (см. рис. 8).", "«Папка заполнена. Ждите», — пишет Wex.", "Конец."],
    "系统提示“模型已满。请稍候。”并停止更新。版本6.9.0只丢弃索引……然后等待。为什么？": ["系统提示“模型已满。请稍候。”并停止更新。", "版本6.9.0只丢弃索引……然后等待。", "为什么？"],
    "画面に「版がいっぱいです。お待ちください。」と表示されます。次です。": ["画面に「版がいっぱいです。お待ちください。」と表示されます。", "次です。"],
    '화면에 "설정 가득 참. 기다리세요."라고 나옵니다. 왜 멈췄습니까?': ['화면에 "설정 가득 참. 기다리세요."라고 나옵니다.', "왜 멈췄습니까?"],
    "डॉ. Nefto की संख्या 62 है। कौन रखता है?": ["डॉ. Nefto की संख्या 62 है।", "कौन रखता है?"],
    "راجع د. Jasmora القائمة رقم 47 أمس. لماذا؟ لا تحذف!": ["راجع د. Jasmora القائمة رقم 47 أمس.", "لماذا؟", "لا تحذف!"],
    "ตารางนี้ใช้เวลา 8.5 วินาทีในการเรียงสาขา โปรแกรม Crulo จะไม่แบ่งไฟล์เดิม": ["ตารางนี้ใช้เวลา 8.5 วินาทีในการเรียงสาขา", "โปรแกรม Crulo จะไม่แบ่งไฟล์เดิม"],
    "older builds stop. set it to 5 gb. a. dov and t. j. nef split the u.s. mirror.": ["older builds stop.", "set it to 5 gb.", "a. dov and t. j. nef split the u.s. mirror."],
    "# Head. One\n\n- item one. Still\n* two\n1. three\n\nQ: How? So?\nA: Well. So.\n\n```\na. B.\n```\nText.": ["# Head. One", "- item one. Still", "* two", "1. three", "Q: How? So?", "A: Well. So.", "```\na. B.\n```", "Text."],
    "a\r\nb.\r\n\r\nC": ["a\r\nb.", "C"],
}


@pytest.mark.parametrize("text", list(CASES))
def test_units(text):
    assert [text[a:b] for a, b in S.units(text)] == CASES[text]


@pytest.mark.parametrize("text", ["", " \n\t ", "...", "?!", '"', "«", "```", "- ", "x" * 200_000, ". " * 5000, "\n".join(["1. a"] * 3000), "(" * 2000])
def test_units_cover_the_text(text):
    at = 0
    for a, b in S.units(text):
        assert a >= at and not text[at:a].strip() and text[a:b].strip() == text[a:b]
        at = b
    assert not text[at:].strip()


def test_table(spark, data):
    df = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "One. Two.", 7)], "doc_id bigint, text string, end_char int")
    assert [(r.doc_id, r.end_char) for r in S.sentence_units(df).orderBy("doc_id", "end_char").collect()] == [(3, 4), (3, 9)]
    assert S.sentence_units(df.limit(0)).count() == 0
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    for r in docs:
        test_units_cover_the_text(r.text or "")


@pytest.mark.parametrize("text", ["သူသွားတယ်။ သူမနေခဲ့တယ်။", "ᠮᠣᠩᠭᠣᠯ᠃ ᠬᠡᠯᠡ᠃", "ܫܠܡܐ܀ ܐܢܬ܀", "ሰላም ነው፧ አዎ ነው።", "ខ្ញុំទៅ។ គាត់នៅ។", "Is it so⁈ It is so﹖", "他走了｡ 她留下了｡"])
def test_terminators_of_all_scripts(text):
    assert len(S.units(text)) == 2


def test_many_marks_and_long_words_take_linear_time():
    began = time.time()
    S.units("([{«" * 50_000 + ")" * 50_000 + ". End.")
    S.units("a." * 200_000 + " Then. " + "b" * 500_000 + ". End here.")
    assert time.time() - began < 20
    deep = "He said " + "(" * 60 + "one. two" + ")" * 60 + " and left. Then more."
    assert [deep[a:b] for a, b in S.units(deep)] == [deep[: deep.index(" Then")], "Then more."]
