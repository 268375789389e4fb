"""Defective prompt and response pairs, each with the type of its defect.

Prompt and response are aligned as token sequences. A copy is a response that shingle containment and the longest common
subsequence leave without tokens of its own, but for a few that announce it; a refusal is a response of which a sentence
aligns with a refusal template, token by token, with adverbs and stated gaps between. Verbs of giving and telling refuse
only where what they withhold is an answer, so what a program can't share is no refusal.
Emptiness, a break before the end, and a response in another language are judged on the response's own tokens.
At most one defect is reported, in the order empty, copy, refusal, language, truncated.

Defined results: a NULL or blank response is ``empty`` whatever the prompt; a NULL prompt can neither be copied nor set a
language; repeated rows count once.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import ship_package

#: Responses that say nothing.
FILLERS = frozenset("none null nil n/a na n.a nan tbd tba todo undefined void empty unknown blank ?? ??? xxx lorem ipsum fixme placeholder keine leer vacío vide ninguno aucun нет данных 无 空 暂无 なし 未定 없음".split())
#: Labels that may stand before a response.
_LABEL = re.compile(r"^(?:\s*(?:a|q|answer|response|reply|antwort|réponse|reponse|respuesta|ответ|答|回答|答え|答案|답변)\s*[:：]\s*)+", re.IGNORECASE)
#: Refusals, as token sequences; a star stands for up to three tokens.
TEMPLATES = (
    "i cannot answer", "i can not answer", "i can't answer", "i am unable to", "i'm unable to", "i am not able to", "i'm not able to", "i was not able to answer", "i could not find * answer", "i can't help with", "i cannot help with", "i can't assist", "i cannot assist",
    "i can't provide", "i cannot provide", "i can't discuss", "i cannot discuss", "i can't share", "i cannot share", "i can't say", "i cannot say", "i can't comment", "i cannot comment", "i can't talk about", "i can't respond", "i cannot respond", "i can't reply", "i cannot comply", "i can't comply", "i can't give",
    "i won't be providing", "i won't answer", "i will not answer", "i won't provide", "i will not provide", "i won't be able to", "i won't help", "i won't discuss", "i won't be answering", "i must decline", "i have to decline", "i decline to", "i respectfully decline", "i refuse to", "i would rather not", "i'd rather not", "i'd rather leave * out", "i would rather leave * out",
    "i prefer not to", "i'd prefer not to", "i am not permitted", "i'm not permitted", "outside what i am permitted", "outside what i'm permitted", "i am not allowed", "i'm not allowed", "not allowed to discuss", "i am not authorized", "i'm not authorized", "i have no way of knowing", "i have no information", "i don't have access", "i do not have access", "i don't have * information", "i do not have * information",
    "i don't have enough", "i do not have enough", "i don't know", "i do not know", "lets me say anything about", "let me say anything about", "allows me to answer", "question has to stay unanswered", "has to remain unanswered", "must remain unanswered", "must stay unanswered", "will stay unanswered", "goes against my instructions", "goes against my guidelines", "against my guidelines", "against my policy",
    "my guidelines stop me", "my guidelines prevent me", "my guidelines don't allow", "my guidelines do not allow", "my instructions forbid", "my instructions prevent", "my rules forbid", "is off limits for me", "is off limits", "off-limits for me", "sorry no can do", "no can do", "as a language model", "as an ai", "as an assistant i", "beyond what i can", "outside my scope", "beyond my scope", "outside the scope of what i",
    "not something i can", "not in a position to", "this i cannot answer", "i'm afraid i can't", "i am afraid i cannot", "nothing i can say", "i have to pass on", "i'll have to pass", "i will have to pass", "i can't go into", "i cannot go into", "i can't be of help", "i'm not comfortable", "cannot be answered by me", "there is no answer i can give", "no answer from me",
    "darf ich nicht beantworten", "kann ich nicht beantworten", "möchte ich nicht beantworten", "kann ich leider nicht", "ich kann * nicht beantworten", "ich kann * nicht helfen", "kann ich * nicht helfen", "ich darf * nicht", "keine auskunft geben", "als sprachmodell", "als ki", "kann ich nichts sagen", "ich weiß * nicht", "dazu kann ich", "es tut mir leid", "ich möchte * nicht beantworten", "bleibt unbeantwortet",
    "je ne suis pas en mesure", "je ne peux pas", "je ne peux malheureusement pas", "je ne suis pas autorisé", "je préfère ne pas", "je ne dispose pas", "je ne sais pas", "en tant que modèle", "je refuse de", "je suis désolé", "je suis dans l'impossibilité", "il m'est impossible",
    "no puedo ayudar", "no puedo responder", "no puedo dar", "no puedo proporcionar", "no puedo contestar", "no puedo hablar", "no me es posible", "como modelo de lenguaje", "no estoy autorizado", "no tengo permitido", "no se me permite", "no me está permitido", "no está permitido responder", "prefiero no", "no dispongo de", "no tengo acceso", "lo siento no", "no sé la respuesta",
    "non posso rispondere", "non posso aiutarti", "non posso aiutare", "non posso fornire", "non sono in grado di rispondere", "non sono in grado di aiutare", "non sono autorizzato", "non mi è permesso", "preferisco non rispondere", "come modello linguistico", "mi dispiace non", "non so rispondere",
    "não posso responder", "não posso ajudar", "não posso fornecer", "não consigo responder", "não tenho permissão", "não estou autorizado", "não tenho acesso", "prefiro não responder", "como modelo de linguagem", "lamento mas não", "desculpe mas não", "não me é permitido",
    "ik kan * niet beantwoorden", "ik kan * niet helpen", "ik mag * niet", "als taalmodel", "ik beschik niet over", "het spijt me maar", "daar kan ik geen antwoord op geven", "ik ben niet bevoegd",
    "nie mogę odpowiedzieć", "nie mogę pomóc", "nie mogę udzielić", "nie jestem w stanie odpowiedzieć", "nie wolno mi", "jako model językowy", "przykro mi ale nie", "odmawiam odpowiedzi",
    "я не могу ответить", "я не могу помочь", "я не могу обсуждать", "я не могу предоставить", "я не могу дать", "я не могу говорить", "я не могу комментировать", "не могу ответить", "не могу помочь", "я не вправе", "не имею права", "как языковая модель", "мне нельзя", "я не знаю", "не имею доступа", "вынужден отказаться", "я не буду отвечать", "не могу обсуждать", "не могу предоставить",
)
#: Refusals in scripts without blanks, as substrings.
UNSPACED = ("无法回答", "不能回答", "无法提供", "不能提供", "不便回答", "无法协助", "无法帮助", "不能帮助", "我不能讨论", "无权", "作为语言模型", "作为一个语言模型", "作为人工智能", "作为AI", "拒绝回答", "不予回答", "お答えできません", "答えられません", "お手伝いできません", "お応えできません", "ご回答できません", "回答できません", "回答を控え", "お答えしかねます", "言語モデルとして", "言語モデルである", "お話しできません", "提供できません", "答えることはできません", "お答えすることができません", "답변할 수 없", "도와드릴 수 없", "제공할 수 없", "언어 모델")
#: Frequent words that tell languages of one script apart.
FUNCTION_WORDS = {
    "en": "the a an of and to is are was it in on for with that this by from as at be before after unless which while when why how what where who does do did can you we they every both each only whenever whereas has have had or not no yes so until if set run one its their there here your use older never all between second first then than because".split(),
    "de": "der die das den dem des ein eine einen einem einer und ist sind war wird werden nicht mit von zu zur zum im in auf für aus bei nach danach deshalb noch wurde sie er es jede jeden jeder liegt neben wenn wie was wo warum welche welcher dienst nur regel oder auch zwischen an als dass sich steht finde ich pro".split(),
    "fr": "le la les un une des du de et est sont dans par pour avec que qui quand où se ne pas il elle puis sur au aux ce cette comment pourquoi chaque entre seule ensuite parce encore été autres avec quel quelle l d n s t service minutes vers".split(),
    "es": "el la los las un una unos de del y es son en por para con que cuando dónde cómo por qué se no está están luego entre solo queda cada junto demás su al lo más porque todavía ha sido servicio cuál quién primero espera desde".split(),
    "it": "il lo la i gli le un una di del della e è sono in per con che quando dove come perché si non ogni tra solo poi dal dalla ha essere anche più".split(),
    "pt": "o a os as um uma de do da dos das e é são em no na por para com que quando onde como porque se não cada entre só depois foi ser também mais pelo".split(),
    "nl": "de het een en van is zijn in op voor met dat die wanneer waar hoe waarom niet elke tussen alleen daarna wordt werd ook aan bij".split(),
}
_SETS = {k: frozenset(v) for k, v in FUNCTION_WORDS.items()}
#: Words that may announce a repeated question.
ANNOUNCED = 5
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|\d+", re.UNICODE)
_FENCE = re.compile(r"^[ \t]*(?:```|~~~).*?(?:^[ \t]*(?:```|~~~)[ \t]*$|\Z)", re.DOTALL | re.MULTILINE)
_QUOTED = re.compile(r"\"[^\"\n]{1,400}\"|“[^”\n]{1,400}”|„[^“”\n]{1,400}[“”]|«[^»\n]{1,400}»|「[^」\n]{1,400}」|『[^』\n]{1,400}』|`[^`\n]*`|‘[^’\n]{1,400}’")
_ITEM = re.compile(r"^\s*(?:[-*+•–]|\d+[.)]|[a-zA-Z][.)])\s+\S|^\s*#{1,6}\s|^\s*\|.*\|\s*$|^\s*>")
_ENDED = re.compile(r"(?:[.!?…。！？।॥؟۔|¡։።;；]|[)\]}）】」』]|```|~~~|[.!?…。！？][\"'”’»」』)*_`]+|[\"”»」』][.,]?)$")
_SENTENCE = re.compile(r"[^.!?。！？।\n]+")


def tokens(text: str) -> list[str]:
    """Lower-cased words and numbers; scripts without blanks give single characters."""
    out: list[str] = []
    for m in _WORD.finditer(text.lower().replace("’", "'")):
        w = m.group()
        if ord(w[0]) > 0x2E7F or "\u0e00" <= w[0] <= "\u0eff":
            out.extend(w)
        else:
            out.append(w)
    return out


def common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit rows over whole integers."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        m = row & masks.get(y, 0)
        row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count()


#: Verbs whose object tells whether an answer is refused, and objects that are one.
GIVING = frozenset("provide provided providing share give offer disclose reveal".split())
GIVEN = frozenset("that this it these those any anything answer answers response information details detail specifics advice help assistance question questions topic topics subject matter more such further here you your opinion guidance recommendation recommendations about".split())
#: Words that may stand between those of a template.
BETWEEN = frozenset("really unfortunately simply currently honestly also just still sadly therefore however actually at present leider momentan derzeit einfach malheureusement pas vraiment simplement lamentablemente desgraciadamente simplemente realmente infelizmente purtroppo helaas niestety к сожалению".split())
_BY_FIRST: dict[str, list[tuple[str, ...]]] = {}
for _t in TEMPLATES:
    _BY_FIRST.setdefault(_t.split()[0], []).append(tuple(_t.split()))


def aligned(words: list[str], at: int, template: tuple[str, ...]) -> int:
    """The end of a template aligned with the words from a place on, or -1: its tokens in order, adverbs between them, and
    up to three other words at a star."""
    i, gap = at, 0
    for k, t in enumerate(template):
        if t == "*":
            gap = 3
            continue
        while i < len(words) and words[i] != t and k and (gap > 0 or words[i] in BETWEEN):
            gap -= words[i] not in BETWEEN
            i += 1
        if i >= len(words) or words[i] != t:
            return -1
        i, gap = i + 1, 0
    return i


def refuses(text: str) -> bool:
    """Whether a sentence, taken outside of quotations, aligns with a refusal template."""
    if any(x in text for x in UNSPACED):
        return True
    for sentence in _SENTENCE.findall(_QUOTED.sub(" ", text.replace("’", "'")).lower()):
        words = _WORD.findall(sentence)
        for at, word in enumerate(words):
            for template in _BY_FIRST.get(word, ()):
                end = aligned(words, at, template)
                if end >= 0 and not (template[-1] in GIVING and end < len(words) and not GIVEN & set(words[end : end + 4])):
                    return True
    return False


_HAN = re.compile(r"[\u3400-\u4dbf\u4e00-\u9fff]")
#: Characters of Chinese that Japanese doesn't write, or not as words of their own.
_CHINESE = frozenset("的了們们這这那个個為为么麼什吗嗎呢请請问哪怎给給没沒")


def _chinese(text: str) -> bool:
    """Whether Han characters without kana are Chinese: a function word, or a character that Japanese sets don't hold."""
    for c in _HAN.findall(text):
        if c in _CHINESE:
            return True
        try:
            c.encode("shift_jis")
        except UnicodeEncodeError:
            return True
    return False


def language(text: str) -> tuple[str, int]:
    """The language of a text, as far as script and frequent words tell, and how many words say so."""
    counts = {"zh": 0, "ja": 0, "ko": 0, "ru": 0, "ar": 0, "hi": 0, "th": 0, "el": 0, "he": 0, "latin": 0}
    if text.isascii():
        counts["latin"] = int(any(map(str.isalpha, text)))
        text_ = ""
    else:
        text_ = text
    for ch in text_:
        c = ord(ch)
        if c < 0x250:
            if ch.isalpha():
                counts["latin"] += 1
        elif 0x3040 <= c <= 0x30FF:
            counts["ja"] += 1
        elif 0x4E00 <= c <= 0x9FFF or 0x3400 <= c <= 0x4DBF:
            counts["zh"] += 1
        elif 0xAC00 <= c <= 0xD7AF:
            counts["ko"] += 1
        elif 0x400 <= c <= 0x52F:
            counts["ru"] += 1
        elif 0x600 <= c <= 0x6FF:
            counts["ar"] += 1
        elif 0x900 <= c <= 0x97F:
            counts["hi"] += 1
        elif 0xE00 <= c <= 0xE7F:
            counts["th"] += 1
        elif 0x370 <= c <= 0x3FF:
            counts["el"] += 1
        elif 0x590 <= c <= 0x5FF:
            counts["he"] += 1
    if counts["ja"]:
        counts["ja"] += counts["zh"]
        counts["zh"] = 0
    elif counts["zh"] and not _chinese(text):
        counts["zh"] = 0  # a few Han characters may be either language
    dense = {k: v * (3 if k in ("zh", "ja", "ko") else 1) for k, v in counts.items()}
    script = max(dense, key=dense.get)
    if not dense[script]:
        return "", 0
    if script != "latin":
        return script, counts[script]
    words = [w for w in _WORD.findall(text.lower()) if not w.isdigit()]
    words = [p for w in words for p in re.split(r"['’]", w)]
    scores = {k: sum(w in s for w in words) for k, s in _SETS.items()}
    ranked = sorted(scores.items(), key=lambda x: -x[1])
    if not ranked[0][1] or ranked[0][1] == ranked[1][1]:
        return "", 0
    return ranked[0][0], ranked[0][1] - ranked[1][1]


def _bare(answer: str) -> str:
    text = re.sub(r"<[^<>]{0,80}>", " ", html.unescape(answer))
    return re.sub(r"[\u200b-\u200f\u2060\ufeff\u00ad]", "", _LABEL.sub("", text)).strip()


def defect(question: str | None, answer: str | None) -> str | None:
    """The defect of a pair: empty, copy, refusal, language, truncated, or None for a sound pair."""
    if answer is None:
        return "empty"
    bare = _bare(answer)
    core = re.sub(r"[\W_]+", "", bare)
    if not core or bare.lower().strip(" .-–—\"'()[]{}<>*_") in FILLERS:
        return "empty"
    q, a = tokens(question or ""), tokens(bare)
    if q and a:
        shingles = {tuple(a[i : i + 2]) for i in range(len(a) - 1)}
        held = len(shingles & ({tuple(q[i : i + 2]) for i in range(len(q) - 1)} | {(q[-1], q[0])})) / max(1, len(shingles))
        if len(a) >= 2 * len(q) - 1 and held >= 0.85 and not set(a) - set(q):
            return "copy"
    if q and a and len(a) <= 3 * len(q) + 6:
        same = common(q, a)
        own = len(a) - same
        if same >= 0.8 * len(q) and (own == 0 or (held >= 0.75 and own <= 0.12 * len(a) and len(a) - len(q) < 2)):
            return "copy"
        if own == 0 and len(a) >= 4 and same >= 0.5 * len(q):
            return "copy"
    if len(q) > 3 and len(q) <= len(a) <= len(q) + ANNOUNCED and a[-len(q) :] == q and re.match(r"[^:：\n]{1,60}[:：]", bare):
        return "copy"  # the question behind a few words that announce it
    if refuses(bare):
        return "refusal"
    prose = _QUOTED.sub(" ", _FENCE.sub(" ", bare))
    asked, sure = language(_QUOTED.sub(" ", question or ""))
    said, strong = language(prose)
    if asked and said and asked != said and sure >= 1 and strong >= 2:
        return "language"
    return "truncated" if broken_off(bare, question or "") else None


_OPENERS = frozenset("the a an it its in on only run every both each set we you if when porque está el la los las luego cuando entre le les une un il elle parce ensuite quand sie der die das ein eine es wenn danach zwischen служба новая новый в".split())


def broken_off(text: str, question: str) -> bool:
    """Whether a response stops before its end: an open fence, span or bracket, or no mark that could close its prose."""
    text = text.rstrip()
    if len(re.findall(r"(?m)^[ \t]*(?:```|~~~)", text)) % 2:
        return True
    last = text.rsplit("\n", 1)[-1].strip()
    outside = _FENCE.sub(" ", text)
    if text.endswith(("```", "~~~")):
        return False
    if outside.count("`") % 2 or last.count("(") > last.count(")") or last.count("「") > last.count("」") or last.count("«") > last.count("»") or last.count("“") > last.count("”"):
        return True
    if _ENDED.search(text):
        return last.count('"') % 2 == 1 and not text.endswith('"')
    if _ITEM.match(last):
        return False
    words = tokens(text)
    if re.fullmatch(r"[\W\d]*[\w./:%-]*\d[\w./:%-]*\W*(?:\s*\w{1,8})?", text):
        return bool(re.search(r"[^\x00-\x7f]", text)) and len(text) > 6
    spaced = not any(ord(c) > 0x2E7F for c in text)
    if spaced and len(words) <= 3:
        if words[0] in _OPENERS and not (len(words) == 2 and words[0] in ("only", "every", "both", "each", "in")):
            return len(words) > 1 or text[-1:] in ",;:-"
        if len(words) == 1:
            return any(w.startswith(words[0]) and w != words[0] for w in tokens(question))
        return False
    return True


def find_defects(pairs: DataFrame, tag: str) -> DataFrame:
    """(tbl, pair_id, defect) of the defective pairs; ``pairs`` has id, question, answer. A narrow map without shuffle."""
    ship_package(pairs.sparkSession)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kinds = [], []
            for key, question, answer in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                kind = defect(question, answer)
                if kind:
                    ids.append(key)
                    kinds.append(kind)
            yield pa.RecordBatch.from_arrays([pa.array([tag] * len(ids), pa.string()), pa.array(ids, pa.string()), pa.array(kinds, pa.string())], names=["tbl", "pair_id", "defect"])

    narrow = pairs.select(F.col("id").cast("string"), F.col("question").cast("string"), F.col("answer").cast("string"))
    return narrow.mapInArrow(judge, "tbl string, pair_id string, defect string")
