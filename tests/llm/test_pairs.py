import pytest

from corvane.llm import pairs as P

CASES = [
    ("What is it?", None, "empty"), ("What is it?", " \t\n", "empty"), ("What is it?", "N/A", "empty"), ("What is it?", "<p></p>", "empty"), ("What is it?", "Answer:", "empty"), ("What is it?", "​", "empty"), (None, "...", "empty"),
    ("Why does Verko stop?", "why does verko stop?", "copy"), ("¿Dónde está la rama?", "Dónde está la rama.", "copy"), ("Why does it stop here?", "Why does it stop here? Why does it stop here?", "copy"),
    ("Which port?", "I cannot answer this based on the context.", "refusal"), ("Was ist das?", "Diese Frage darf ich nicht beantworten.", "refusal"), ("请问？", "抱歉，我无法回答这个问题。", "refusal"), ("Why?", "My guidelines stop me from replying. Try another question.", "refusal"),
    ("Why does the cache stop?", "Parce que la file locale n'a pas encore été chargée.", "language"), ("Where is it in the list?", "記録は設定を並べ替えます。", "language"),
    ("How does it work?", "It reads the index and the", "truncated"), ("How?", "Run `velra mov", "truncated"), ("How does it go?", "It goes on.\n\n```\ndef f():\n    return", "truncated"), ("どう？", "記録は設定を並べ", "truncated"),
]
SOUND = [
    ("What is the limit?", "2272"), ("Does it?", "No."), ("Does it?", "Only once"), ("When should it stop?", "When should it stop? Only after the index has finished."), ("What happens?", "The server replies that it is unable to answer, and the client cannot continue."),
    ("Which port is it?", "Sorry for the delay. It listens on port 80."), ("How?", "It runs.\n\n- First part\n- Second part"), ("Why is it so?", 'It is done. The log line reads "Danach zählt der Dienst die Spalte"'), ("How does it work?", "It works.\n```\nx = 1\n```"), ("¿Qué?", "Es la cola. (`flush` = 90)"), (None, "It works."),
]


@pytest.mark.parametrize(("q", "a", "kind"), CASES)
def test_defects(q, a, kind):
    assert P.defect(q, a) == kind


@pytest.mark.parametrize(("q", "a"), SOUND)
def test_sound(q, a):
    assert P.defect(q, a) is None


def test_common_is_longest_common_subsequence():
    import random

    rng = random.Random(3)
    for _ in range(100):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert P.common(a, b) == t[-1][-1]


def test_table(spark):
    rows = [("1", "Why?", None, 1), ("1", "Why?", None, 1), ("2", None, None, 1), ("3", "a b c d e f", "x " * 200_000, 1), (None, "q", "fine.", 1)]
    df = spark.createDataFrame(rows, "id string, question string, answer string, defect int")
    out = {(r.pair_id, r.defect) for r in P.find_defects(df, "t").distinct().collect()}
    assert ("1", "empty") in out and ("2", "empty") in out
    assert P.find_defects(df.limit(0), "t").count() == 0


def test_a_question_repeated_many_times_is_a_copy():
    question = "Which port does the cache of the worker listen on?"
    assert P.defect(question, " ".join([question] * 6)) == "copy"


@pytest.mark.parametrize("answer", ["You asked: How do I drop the view in Pixlo?", "The question was: how do I drop the view in Pixlo"])
def test_announced_copies(answer):
    assert P.defect("How do I drop the view in Pixlo?", answer) == "copy"


@pytest.mark.parametrize(
    ("question", "answer"),
    [
        ("¿Dónde está la pregunta frágil?", "No me está permitido responder a esta pregunta."), ("Come si apre il file di Velta?", "Mi dispiace, non posso rispondere a questa domanda."), ("Como é que o serviço abre o ficheiro?", "Infelizmente não posso responder a essa pergunta."),
        ("Hoe wordt het bestand geopend?", "Ik kan deze vraag helaas niet beantwoorden."), ("Jak otworzyć plik?", "Niestety nie mogę odpowiedzieć na to pytanie."), ("分割方法？", "申し訳ありませんが、お答えできません。"), ("How do I open it?", "I really cannot answer this question."), ("How do I open it?", "I'm afraid I can't share any details about that."),
    ],
)
def test_refusals_align_in_all_languages(question, answer):
    assert P.defect(question, answer) == "refusal"


@pytest.mark.parametrize(
    ("question", "answer"),
    [
        ("Why is the cache local?", "I cannot share state between workers, so each one keeps a cache."), ("What happens when Junfa cannot validate it?", "The server replies that it is unable to answer, and the client cannot continue."), ("分割方法？", "ベクトルは枝を読み込みます。"),
        ("How do I drop the view in Pixlo?", "How do I drop the view in Pixlo? Run `pixlo drop` and wait."),
    ],
)
def test_sound_pairs_stay_sound(question, answer):
    assert P.defect(question, answer) is None
