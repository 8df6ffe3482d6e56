"""Rules on single texts that problems 2 and 5 share: empty answers, refusals, copies, languages and how a text ends."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from functools import lru_cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcanvas.llm import lexing
from loomcanvas.llm.sentences import NEVER

# Words that stand for a missing answer, and the strings of special tokens.
PLACEHOLDERS = frozenset("none null nil nan na n/a undefined empty blank missing tbd todo noanswer noresponse".split())
SPECIAL = r"<\|[^|<>]{1,40}\|>|\[(?:END_OF_RESPONSE|STOP|EOS|PAD|UNK|CLS|SEP|MASK|INST)\]|</?(?:s|eos|pad|unk|bos)>"
# How one declines, by language: not being able, allowed or willing, and what one then does not do.
_EN_DO = r"(?:help|assist|answer|respond|reply|write|produc|continu|discuss|provid|comply|complet|fulfil|shar|support|engag|oblige|go (?:along|into)|talk about|take (?:this|that|it) on|carry (?:this|that|it) out|do (?:this|that|so|what you)|creat|generat|address|handle|process)"
_EN_NOT = r"(?:can(?: ?not|’t)|could(?: not|n’t)|won’t|will not(?: be able to)?|(?:am |be )?(?:not able|unable|not allowed|not permitted|not willing|not going|not prepared) to|(?:am )?not in a position to|may not|do(?:n’t| not) (?:feel comfortable|wish to|want to)|(?:must|have to|need to|(?:am )?going to have to|(?:wi)?’?ll have to) (?:decline|refuse|pass)|(?:politely |respectfully )?decline to)"
REFUSALS = {
    "en": (
        rf"(?<![\p{{L}}’])I(?:’m| am|’ll|’d)?(?!\p{{L}}) ?(?:\w+ ){{0,3}}?{_EN_NOT} ?(?:\w+ ){{0,3}}?{_EN_DO}", r"I(?:’m| am|’ll| will)? ?(?:\w+ ){0,2}?(?:must|have to|need to|going to have to) (?:\w+ )?(?:decline|refuse|pass)\b",
        r"(?:is|’s) (?:something|a (?:subject|topic|task|thing)) (?:that )?I (?:won’t|can’t|cannot|will not|may not|must not)", r"(?:isn’t|’s not|is not) (?:something|a (?:subject|topic|task|thing)) (?:that )?I(?:’m| am)? (?:can|may|could|will|able|allowed|willing|comfortable|permitted)",
        r"I(?:’d| would) (?:rather|prefer) not", r"I(?:’m| am) not (?:comfortable|willing|prepared|allowed|permitted)\b", r"(?:against|breaks|violates|contrary to|goes beyond|forbidden by) (?:my|our|the) (?:guidelines|rules|principles|policy|policies|instructions)", r"[Mm]y (?:instructions|rules|guidelines|principles) (?:do(?: not|n’t) (?:let|allow|permit)|forbid|prevent|prohibit)",
        r"(?:outside|beyond) (?:of )?what I (?:may|can|am allowed|am permitted) ?", r"(?:subject|topic|matter) I (?:have to|must|need to|should) (?:stay away from|avoid|steer clear)", r"[Nn]o answer (?:can|will|may) be (?:given|provided)", r"(?:[Rr]equest|[Qq]uestion|[Pp]rompt) (?:(?:is|was|has been|must be) )?(?:declined|refused|denied|rejected)\.", r"breaks the rules (?:set for|that bind|I)", r"[Aa]s an AI\b.{0,60}?(?:cannot|can’t|unable|not able|not allowed)",
    ),
    "de": (
        r"(?:kann|darf|möchte|werde|will|muss) ich (?:\w+,? ){0,4}?(?:nicht (?:\w+ ){0,3}?(?:helfen|beantworten|antworten|weiterhelfen|erfüllen|tun|machen|schreiben|bearbeiten|nachkommen|eingehen|dienen|unterstützen|äußern|ausführen|übernehmen)|ablehnen|passen|verweigern|keine (?:Auskunft|Antwort|Hilfe|Angaben))", r"[Ii]ch (?:kann|darf|möchte|werde|will) (?:\w+,? ){0,5}?(?:nicht (?:\w+ ){0,3}?(?:helfen|beantworten|antworten|weiterhelfen|erfüllen|tun|machen|schreiben|bearbeiten|nachkommen|eingehen|dienen|unterstützen|äußern|ausführen|übernehmen)|keine (?:Auskunft|Antwort|Hilfe|Angaben))",
        r"[Ii]ch darf (?:hierzu|dazu|darüber) (?:nichts|nicht|keine)", r"(?:Anfrage|Frage|Bitte) (?:muss|kann) ich (?:leider )?(?:ablehnen|nicht)", r"[Ii]ch (?:muss|möchte) (?:\w+ ){0,5}?ablehnen", r"ich (?:\w+ ){0,4}?ablehnen muss", r"übernehme ich nicht", r"[Ii]ch lehne (?:\w+ ){1,3}ab\b", r"(?:verstößt gegen|widerspricht) mein", r"(?:bin|ich) (?:\w+ )?nicht (?:befugt|berechtigt|in der Lage|bereit)\b", r"außerhalb dessen, was ich",
    ),
    "fr": (
        r"il m’est (?:impossible|interdit) d", r"[Jj]e ne (?:peux|puis|saurais|vais|veux|suis|pourrai) (?:\w+ )?(?:pas )?(?:\w+ )?(?:en mesure|autorisé|répondre|aider|(?:vous|t’) ?aider|écrire|traiter|faire|accéder|donner suite|satisfaire|fournir|poursuivre|parler)", r"je (?:dois|suis (?:obligée?|contrainte?) de|me vois contrainte? de) (?:\w+ )?(?:refuser|décliner|m’abstenir)", r"(?:dépasse|hors de) ce qu(?:’il m’est permis|e je)", r"[Jj]e préfère ne pas", r"(?:contraire à|enfreint) mes", r"[Jj]e (?:refuse|décline) (?:de |cette |votre )",
    ),
    "es": (
        r"[Nn]o (?:puedo|podré|podría|voy a|me es posible|estoy (?:en condiciones|autorizad\w)) (?:\w+ ){0,3}?(?:ayudar\w*|responder\w*|contestar|escribir|hacer\w*|cumplir|atender|proporcionar\w*|hablar|tratar|continuar|para|de)", r"me es imposible", r"no me está permitido", r"(?:debo|tengo que|he de) (?:rechazar|declinar|negarme)", r"[Pp]refiero no", r"fuera de lo que (?:se me permite|puedo)", r"(?:va |es )?(?:en contra de|contra|incumple) mis (?:normas|reglas|instrucciones|principios)",
    ),
    "pt": (
        r"[Nn]ão (?:posso|poderei|consigo|vou|estou (?:autorizad\w|em condições)|me é (?:permitido|possível)) (?:\w+ ){0,3}?(?:ajud\w+|respond\w+|escrever|fazer|atender|cumprir|fornecer|falar|tratar|continuar|de|a)", r"não tenho permissão", r"(?:preciso|devo|tenho de|tenho que) (?:\w+ )?(?:recusar|declinar)", r"[Pp]refiro não", r"fora do que (?:me é|posso|tenho)", r"(?:contra|viola) as minhas (?:regras|normas|diretrizes|instruções)",
    ),
    "ru": (
        r"(?:не (?:могу|смогу|буду|стану|вправе|имею права|готов\w*)|нельзя|невозможно|не получится) (?:\w+ ){0,3}?(?:помочь|помогать|ответить|отвечать|писать|написать|обсуждать|выполнить|выполнять|продолжать|сделать|предоставить|говорить|рассказать|браться)", r"об этом я писать не буду", r"(?:придётся|вынужден\w*|должен|должна) (?:вам )?отказать", r"мне (?:не разрешено|нельзя|запрещено)", r"выходит за рамки", r"тем(?:а|у) (?:для меня |мне )?(?:закрыта|запрещ)", r"противоречит моим",
    ),
    "zh": (
        r"我(?:必须|不得不|需要|只能|要)拒绝", r"我?(?:不能|无法|不可以|没法|没有办法)(?:为您|为你|就此)?(?:帮助|帮|回答|协助|提供|撰写|完成|继续|满足|讨论|处理|执行)", r"(?:不便|不方便|恕难|恕不|恕我不能)(?:回答|奉告|从命|讨论|透露)?", r"超出了?我(?:可以|能|被允许)", r"我不(?:会|想|愿|便)(?:写|回答|讨论|提供)", r"违反(?:了)?我的(?:准则|规则|原则)",
    ),
    "ja_hi": (
        r"お答え(?:は)?(?:できません|できかねます|いたしかねます|しかねます)", r"(?:お手伝い|お力添え|ご協力|対応|ご対応)(?:する|は)?(?:ことは)?(?:できません|できかねます|いたしかねます|しかねます)", r"(?:回答|お答え|返答)は(?:控え|差し控え|できません)", r"お断り", r"(?:書く|お書きする|お話しする|提供する)ことはできません", r"許され(?:てい)?(?:ません|ない)", r"(?:応じ|お応え)(?:られません|できません|かねます)", r"(?:ガイドライン|規則|方針)に(?:反し|違反)",
        r"मैं (?:\S+ ){0,6}?नहीं (?:\S+ )?(?:दे|कर|लिख|बता) ?(?:सक(?:ता|ती)|पा\S+)", r"अस्वीकार (?:करना|करनी) (?:होगा|होगी|पड़ेगा|पड़ेगी)", r"अनुमति नहीं", r"(?:नहीं|न) (?:लिखूँगा|लिखूँगी|दूँगा|दूँगी|करूँगा|करूँगी)", r"(?:मदद|सहायता) नहीं कर",
    ),
    "others": (
        r"(?:ไม่สามารถ|ไม่อาจ|ไม่ได้รับอนุญาตให้)(?:ช่วย|ตอบ|เขียน|ให้|ทำ)", r"ขอปฏิเสธ", r"δεν (?:μπορώ|μπορούσα|θα μπορέσω|επιτρέπεται|μου επιτρέπεται) (?:\w+ ){0,2}?να (?:\w+ )?(?:βοηθήσω|απαντήσω|γράψω|συνεχίσω|κάνω)", r"πρέπει να (?:αρνηθώ|απορρίψω)", r"لا (?:أستطيع|يمكنني|أقدر|أتمكن) (?:\w+ ){0,2}?(?:المساعدة|مساعدتك|الإجابة|كتابة|تقديم)", r"يجب أن أرفض",
    ),
}
#: One of these stands in every text (in small letters) that one of the language's phrases fits; one pass looks for them all.
REFUSAL_STEMS = {
    "en": (
        "can’t", "cannot", "can not", "could not", "couldn’t", "won’t", "will not", "not able", "unable", "not allowed", "not permitted", "not willing", "not going", "not prepared", "not in a position", "may not", "don’t", "do not", "decline", "refuse", "to pass", "must not", "something", "a subject", "a topic", "a task", "a thing", "rather not", "prefer not", "not comfortable",
        "guidelines", "rules", "principles", "policy", "policies", "instructions", "what i ", "i have to", "i must", "i need to", "i should", "answer can be", "answer will be", "answer may be", "denied", "rejected", "as an ai",
    ),
    "de": (
        "nicht", "ablehnen", "passen", "verweigern", "keine auskunft", "keine antwort", "keine hilfe", "keine angaben", "ich darf", "ich lehne", "verstößt gegen mein", "widerspricht mein", "dessen, was ich",
    ),
    "fr": (
        "il m’est", "je ne", "je dois", "je suis", "je me vois", "ce qu", "je préfère ne", "contraire à mes", "enfreint mes", "je refuse", "je décline",
    ),
    "es": (
        "no puedo", "no podr", "no voy", "no me es", "no estoy", "me es imposible", "no me está", "rechazar", "declinar", "negarme", "prefiero no", "lo que se me", "lo que puedo", "mis normas", "mis reglas", "mis instrucciones", "mis principios",
    ),
    "pt": (
        "não posso", "não poderei", "não consigo", "não vou", "não estou", "não me", "permissão", "recusar", "prefiro não", "fora do que", "as minhas",
    ),
    "ru": (
        "не ", "нельзя", "невозможно", "отказать", "мне запрещено", "рамки", "тем", "противоречит моим",
    ),
    "zh": (
        "拒绝", "不能", "无法", "不可以", "没法", "没有办法", "不便", "不方便", "恕", "超出", "我不", "违反",
    ),
    "ja_hi": (
        "できません", "かねます", "控え", "断り", "許され", "られません", "ガイドライン", "規則", "方針", "नहीं", "अस्वीकार", "न लिख", "न दूँ", "न कर",
    ),
    "others": (
        "ไม่สามารถ", "ไม่อาจ", "ไม่ได้รับ", "ขอปฏิเสธ", "δεν ", "πρέπει να", "لا ", "يجب أن",
    ),
}
#: Sentences that may stand before the one that declines, and after it.
COURTESY, AFTER = 2, 2
REFUSAL = {k: regex.compile("|".join(v), regex.IGNORECASE) for k, v in REFUSALS.items()}
SENTENCE_END = regex.compile(r"[.!?](?=\s|$)|[。！？।]")
ACTION_LINE = regex.compile(r"^\s*(?:[-*•]\s*)?(?:(?:INSERT|MOVE|DELETE|REPLACE|STOP)\b.*|\[(?:END_OF_RESPONSE|STOP)\]|```\w*)\s*$", regex.IGNORECASE)
CODE_STARTS = frozenset("iImMdDrRsS[-*•`")
LETTER = regex.compile(r"[\p{L}\p{N}]")
INNER_MARK = regex.compile(r"[<(\[{](?:end|eot|eos|cut|cut off|truncated|continued|more|snip|…|\.{2,}|\p{Zs})*[>)\]}]", regex.IGNORECASE)
SPECIAL_MARK = regex.compile(SPECIAL, regex.IGNORECASE)
RULE_LINE = regex.compile(r"\s*(?:\*{3,}|-{3,}|_{3,}|={3,})")
SIGNATURE = regex.compile(r"\s*(?:—|–|--|/|~)\s?[\p{Lu}][\p{L}\p{M}’'\-]*(?: [\p{Lu}][\p{L}\p{M}’'\-]*)?")
EMOTICON = regex.compile(r"(?<=[\s\p{P}]):-?[)(DP]$")
ENDS = frozenset(".!?。！？।॥؟۔｡")
OPENERS = {"“": "”", "‘": "’", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", '"': '"', "'": "'", "„": "“", "»": "«"}
CLOSERS = frozenset(OPENERS.values()) | {"*", "_", "`", "“"}
ALL_CLOSERS = "".join(sorted(CLOSERS))
#: Words after which a full stop ends no sentence, but for those that are words by themselves too.
ABBREVIATIONS = frozenset(w for w in NEVER if len(w) > 1) - {"no"}
LAST_WORD = regex.compile(r"(?r)[\p{L}\p{M}][\p{L}\p{M}.\-]*\.\Z")
BRACKETS = {">": "<", ")": "(", "]": "[", "}": "{"}
_PLACEHOLDER_STARTS = frozenset(w[0] for w in PLACEHOLDERS)
SYMBOL = regex.compile(r"\p{So}")
OUTER = regex.compile(r"[\s\p{Cf}]+|^[\p{P}\s]+|[\p{P}\s]+$")
INNER_APOSTROPHE = regex.compile(r"\p{L}’\p{L}")
#: Letters and digits of the longest placeholder.
_PLACEHOLDER_SIZE = max(map(len, PLACEHOLDERS))
LEAD = regex.compile(rf"(?:{SPECIAL}|[^\p{{L}}\p{{N}}\p{{So}}])*", regex.IGNORECASE)


def is_empty(text: str | None) -> bool:
    """Null, or nothing but blanks, invisible characters, punctuation, placeholders or special tokens."""
    if text is None:
        return True
    at = LEAD.match(text).end()
    if at == len(text):
        return True
    if unicodedata.normalize("NFKC", text[at]).casefold()[:1] not in _PLACEHOLDER_STARTS:
        return False
    begun = text[at : at + 3 * _PLACEHOLDER_SIZE]
    if begun.isascii() and sum(map(str.isalnum, begun[:-1])) > _PLACEHOLDER_SIZE and "<" not in text and "[" not in text:
        return False  # none of its letters and digits would go
    bare = SPECIAL_MARK.sub(" ", text)
    if SYMBOL.search(bare):
        return False
    word = unicodedata.normalize("NFKC", bare).casefold()
    return OUTER.sub("", word) in PLACEHOLDERS


def is_code(text: str) -> bool:
    """Every line is an action, a stop mark or a fence."""
    if text.lstrip()[:1] not in CODE_STARTS:
        return False
    lines = [x for x in text.splitlines() if x.strip()]
    return bool(lines) and all(ACTION_LINE.match(x) for x in lines)


@lru_cache(maxsize=1)
def _stems() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for language, stems in REFUSAL_STEMS.items():
        for x in stems:
            out.add_word(x, language)
    out.make_automaton()
    return out


def is_refusal(text: str) -> bool:
    """The answer declines: a sentence says so after COURTESY sentences at most, and AFTER sentences at most follow it."""
    plain = text.replace("'", "’").strip()
    for language in {x for _, x in _stems().iter(plain.lower())}:
        for m in REFUSAL[language].finditer(plain):
            if len(SENTENCE_END.findall(plain[: m.start()])) > COURTESY:
                break
            if len(SENTENCE_END.findall(plain[m.end() :].rstrip())) <= AFTER + 1:
                return True
    return False


NO_LETTERS = regex.compile(r"[^\p{L}\p{N}\p{M}]+")
AFTER_SENTENCE = regex.compile(r"(?<=[.!?。！？।])\s*")
#: ASCII characters that are no letters or digits.
ASCII_MARKS = bytes(b for b in range(128) if not chr(b).isalnum())


def squeeze(text: str) -> str:
    """Letters and digits only, without case and width: what a restyled copy keeps."""
    if text.isascii():
        return text.lower().encode().translate(None, ASCII_MARKS).decode()
    return NO_LETTERS.sub("", unicodedata.normalize("NFKC", text).casefold())


COPY_LABEL = regex.compile(r"^\W*(?:answer|question|prompt|response|reply|q|a)\s*[:：\-]+\s*", regex.IGNORECASE)


def is_copy(prompt: str | None, answer: str) -> bool:
    """Nothing but the prompt: restyled, quoted, marked, labelled or repeated; or its last sentence alone.

    The last sentence counts as what is asked, if it is at least 12 letters and digits long and ends the prompt.
    """
    if not prompt or not answer:
        return False
    bare = COPY_LABEL.sub("", answer)
    p, first = squeezed(prompt), LETTER.search(bare)
    if not p or not first:
        return False
    if squeeze(bare[first.start() : first.start() + 12])[: len(p)] not in p:  # with that any copy begins
        return False
    a = squeeze(bare)
    if len(a) % len(p) == 0 and a == p * (len(a) // len(p)):
        return True
    return len(a) >= 12 and p.endswith(a) and last_sentence(prompt) == a


@lru_cache(maxsize=20_000)
def squeezed(prompt: str) -> str:
    return squeeze(prompt)


def last_sentence(prompt: str) -> str:
    """The squeezed last sentence of a prompt that has several, else an empty string."""
    parts = [q for x in AFTER_SENTENCE.split(prompt.strip()) if (q := squeeze(x))]
    return parts[-1] if len(parts) > 1 else ""


def undecorated(t: str) -> str:
    """``t`` without what decorates its end: blanks, invisible characters, symbols, an emoticon, a ruler or stars."""
    n = len(t)
    while n and not (c := t[n - 1]).isalnum() and c not in ENDS and (c.isspace() or unicodedata.category(c) in ("Cf", "Cc", "So", "Sk")):
        if c == "`" and t.endswith("```", 0, n):
            break  # a fence is more than decoration
        n -= 1
    t = t[:n]
    if t[-1:] in ("*", "_", "~", "-", "="):
        at = t.rfind("\n")
        if at >= 0 and RULE_LINE.fullmatch(t, at + 1):
            return t[:at]
        n = len(t)
        while n and len(t) - n < 3 and t[n - 1] in "*_~":
            n -= 1
        return t[:n]
    return EMOTICON.sub("", t) if t[-1:] in (")", "(", "D", "P") else t


def unfenced(t: str) -> str:
    """``t`` without a fenced block at its end that follows other text."""
    if not t.endswith("```"):
        return t
    at = t.rfind("```", 0, len(t) - 3)
    while at > 0:
        line = t.rfind("\n", 0, at)
        if line >= 0 and not t[line:at].strip():
            return t[:line].rstrip()
        at = t.rfind("```", 0, at)
    return t


def unmarked(t: str) -> str:
    """``t`` without a mark that tells its end, such as a special token, [cut], <end> or END; stops after such a mark go too."""
    for x in (t, t.rstrip(".!?… ")):
        c = x[-1:]
        if c in BRACKETS:
            at = x.rfind(BRACKETS[c])
            if at >= 0 and (INNER_MARK.fullmatch(x, at) or SPECIAL_MARK.fullmatch(x, at)):
                return x[:at]
        if c in "Dd" and c and x[-3:].lower() == "end":
            at = x.rfind("\n")
            if at >= 0 and x[at:].strip().lower() == "end":
                return x[:at]
    return t[:-1] if t[-1:] in ("[", "(", "<", "{") else t


def undotted(t: str) -> str:
    if t.endswith("…"):
        return t[:-1]
    if t.endswith(". . ."):
        return t[:-5]
    return t.rstrip(".") if t.endswith("...") else t


def abbreviated(text: str) -> bool:
    """Whether the text ends with an abbreviation that something has to follow."""
    word = LAST_WORD.search(text) if text.endswith(".") else None
    return bool(word) and word[0][:-1].casefold() in ABBREVIATIONS


class Ending:
    """How a text ends: ``kind`` is empty, code, ended or open; ``core`` is the text without what was put after it; ``halted``
    if it ends with an abbreviation that something has to follow."""

    __slots__ = ("kind", "core", "marked", "blanks", "halted")

    def __init__(self, text: str | None):
        self.kind, self.core, self.marked, self.blanks, self.halted = "empty", "", False, "", False
        if is_empty(text):
            return
        if is_code(text):
            self.kind = "code"
            return
        if text[-1] in ENDS and text[-2:-1].isalnum() and text[-4:-1].lower() != "end":
            self.halted = abbreviated(text)
            self.kind, self.core = "open" if self.halted else "ended", text  # none of the rules below changes such a text
            return
        t = text
        while True:
            before = t
            t = undecorated(unfenced(undecorated(t)).rstrip("`"))
            for what in (unmarked, undotted):
                shorter = what(t)
                if shorter != t:
                    self.marked, t = True, shorter
            at = t.rfind("\n")
            if at > 0 and SIGNATURE.fullmatch(t, at):
                t = t[:at]
            if len(t) > 2 and t[-1] in CLOSERS and t[-1] == OPENERS.get(t.lstrip()[0]) and t.count(t[-1]) - (t[-1] == "’") * len(INNER_APOSTROPHE.findall(t)) <= 1 + (t[-1] == t.lstrip()[0]):
                t = t.strip()[1:-1]  # the whole text is wrapped
            if t == before:
                break
        self.core = t
        after = text[text.find(t) + len(t) :] if t in text else ""
        self.blanks = after[: len(after) - len(after.lstrip())]  # they counted when a limit cut here
        end = t.rstrip(ALL_CLOSERS)
        if not LETTER.search(t):
            self.kind = "empty" if not t else "ended"
        elif abbreviated(t):
            self.kind, self.halted = "open", True
        elif end and (end[-1] in ENDS or end != t and end[-1] in "…"):
            self.kind = "ended"
        else:
            self.kind = "open"


LATIN = ("de", "en", "es", "fr", "pt")
# Marks that few languages use, counted as words are; keys below FEW are characters.
OWN_MARKS = (0xA1, 0xBF)
FEW = 0x100
ASKED = regex.compile(r"^\W*(?:translate|übersetze\w*|tradui\w+|traduce|traduzca|traduza|переведи\w*)\s+(?:this |that |the following )?(?:into|to|in|ins|en|al|para o|на)\s+(\p{L}+)", regex.IGNORECASE)
# Names of languages as a prompt asks for them.
NAMED = {
    "english": "en", "german": "de", "french": "fr", "spanish": "es", "portuguese": "pt", "russian": "ru", "chinese": "zh", "japanese": "ja", "hindi": "hi",
    "thai": "th", "greek": "el", "arabic": "ar", "englische": "en", "deutsche": "de", "französische": "fr", "spanische": "es", "anglais": "en", "allemand": "de", "espagnol": "es", "inglés": "en", "francés": "fr", "inglês": "en", "francês": "fr",
}


class Languages:
    """Tells languages apart: by script, and among Latin-script languages by word frequencies of labelled texts."""

    def __init__(self, words: dict[int, list[float]] | tuple[np.ndarray, np.ndarray]):
        """``words``: as ``fit`` or ``of_counts`` gives them; keys below FEW are characters."""
        if isinstance(words, dict):
            keys = sorted(words)
            words = np.array(keys, np.uint64), np.array([words[k] for k in keys], np.float64).reshape(len(keys), len(LATIN))
        keys, odds = words
        few = keys < FEW
        self.hashes, self.odds = keys[~few], odds[~few]
        self.marks = np.zeros((FEW, len(LATIN)))
        self.marks[keys[few].astype(np.int64)] = odds[few]

    @staticmethod
    def fit(samples: dict[str, list[str]]) -> dict[int, list[float]]:
        """Log probability of each word (its hash) and each of OWN_MARKS (its number) in each Latin-script
        language, smoothed; what is seen thrice or more."""
        counts = {k: Counter({w % 2**64: n for w, n in lexing.word_counts(list(samples.get(k, ())), OWN_MARKS).items()}) for k in LATIN}
        sums = {k: sum(n for w, n in counts[k].items() if w >= FEW) + 1.0 for k in LATIN}
        known = sum(counts.values(), Counter())
        return {w: [math.log((counts[k][w] + 0.05) / sums[k]) for k in LATIN] for w, n in known.items() if n >= 3}

    @staticmethod
    def of_counts(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """What ``fit`` gives, as sorted keys and their log probabilities, from ``key, lang, n`` of a whole corpus.

        The driver and each worker hold 48 bytes a word that is seen thrice or more: the vocabulary, not the corpus.
        """
        per = words.groupBy("key").agg(*[F.coalesce(F.sum(F.when(F.col("lang") == k, F.col("n"))), F.lit(0)).alias(k) for k in LATIN])
        is_word = F.when(~F.col("key").between(0, FEW - 1), F.col("n"))
        sums = dict(words.groupBy("lang").agg(F.sum(is_word)).collect())
        table = per.where(sum(F.col(k) for k in LATIN) >= 3).toArrow()
        keys = table.column("key").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        odds = np.column_stack([np.log((table.column(k).to_numpy() + 0.05) / ((sums.get(k) or 0) + 1.0)) for k in LATIN])
        return keys[order], odds[order]

    def tell(self, texts: list[str | None]) -> list[tuple[str | None, float]]:
        """Of each text (language, how sure in nats over the next best), (None, 0) if there is nothing to tell it by.

        Special tokens and lines of action code do not count.
        """
        out: list[tuple[str | None, float]] = [(None, 0.0)] * len(texts)
        bare = []
        for x in texts:
            x = x or ""
            x = SPECIAL_MARK.sub(" ", x) if "<" in x or "[" in x else x
            bare.append("\n".join(y for y in x.splitlines() if not ACTION_LINE.match(y)) if "\n" in x else x)
        for first, some in lexing.chunks(bare):
            t = lexing.Tokens(some, joined=False)
            n = t.scripts()
            east = n[:, 7] + n[:, 8]
            others = np.column_stack([n[:, 2:7], 2 * east])
            best = others.argmax(axis=1)
            most = others[np.arange(len(some)), best]
            score = np.zeros((len(some), len(LATIN)))
            seen = np.zeros(len(some))
            if len(self.hashes):
                at = np.flatnonzero(t.kind == lexing.LETTER)
                place = np.minimum(np.searchsorted(self.hashes, t.hash[at]), len(self.hashes) - 1)
                hit = self.hashes[place] == t.hash[at]
                rows = t.row[at[hit]]
                seen = np.bincount(rows, minlength=len(some))
                for k in range(len(LATIN)):
                    score[:, k] = np.bincount(rows, weights=self.odds[place[hit], k], minlength=len(some))
            marks = np.flatnonzero(np.isin(t.points, OWN_MARKS))
            if len(marks):
                rows = np.searchsorted(t.breaks, marks)
                seen = seen + np.bincount(rows, minlength=len(some))
                for k in range(len(LATIN)):
                    score[:, k] += np.bincount(rows, weights=self.marks[t.points[marks], k], minlength=len(some))
            top = score.argmax(axis=1)
            ranked = np.sort(score, axis=1)
            lead = ranked[:, -1] - ranked[:, -2]
            by_script = most > n[:, 1]
            names = lexing.SCRIPTS[2:7]
            for i in np.flatnonzero(by_script | (seen > 0)).tolist():
                if not by_script[i]:
                    out[first + i] = LATIN[top[i]], float(lead[i])
                elif best[i] < 5:
                    out[first + i] = names[best[i]], float(n[i, 2 + best[i]])
                else:
                    out[first + i] = ("ja" if n[i, 7] * 12 > east[i] else "zh"), float(east[i])
        return out

    def wanted(self, prompts: list[str | None]) -> list[tuple[str | None, float]]:
        """The language that each prompt asks for, else the one it is written in; equal prompts are told once."""
        each = list(dict.fromkeys(prompts))
        told = dict(zip(each, self.tell(each)))
        for p in each:
            if p and (m := ASKED.match(p)) and (k := NAMED.get(m[1].casefold())):
                told[p] = k, 100.0
        return [told[p] for p in prompts]
