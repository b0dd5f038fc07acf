"""Broken question-answer pairs: ordered rules that emit every defect type they find.

The rules look at the two texts of a row only. In order: emptiness, copied question, refusal phrases of nine languages,
unclosed delimiters and abrupt endings, mismatch of script and language. A pair with several defects has a row for
each; ``rank`` tells the order of the rules, and the first is the one that explains the others (a refusal in another
language than the question is a refusal first).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import WORD, words

DEFECTS = ("empty", "question_copy", "refusal", "truncated", "other_language")

# --- empty ---

_MARKUP = re.compile(r"<think>.*?</think>|<[^<>\n]{1,40}>|```\w*", re.S | re.I)
_LABEL = re.compile(r"^\W*(?:answer|response|antwort|réponse|respuesta|resposta|risposta|antwoord|ответ)\s*:", re.I)
# What stands for no answer.
_PLACEHOLDER = {"", "n a", "na", "nan", "null", "none", "nil", "error", "no response", "no answer", "empty", "blank", "todo", "tbd", "undefined", "missing", "not available", "not applicable", "placeholder", "answer", "response", "no data", "unknown"}


def is_empty(answer: str | None) -> bool:
    if not answer:
        return True
    left = _LABEL.sub("", _MARKUP.sub(" ", answer).strip())
    return " ".join(words(left)) in _PLACEHOLDER


# --- copied question ---

_DRESS = re.compile(
    r"^\W*(?:(?:you (?:asked?|wrote|want to know)|(?:the |your )?(?:question|prompt|query)(?: is| was)?|q|user|human|"
    r"(?:die |ihre )?frage(?: lautet| ist)?|sie fragen|(?:la |votre )?question(?: est)?|vous demandez|(?:la |su )?pregunta(?: es)?|usted pregunta|"
    r"(?:a |sua )?pergunta(?: é)?|você pergunt\w+|(?:la |sua )?domanda(?: è)?|lei chiede|(?:de |uw )?vraag(?: is| luidt)?|u vraagt|вопрос|вы спрашиваете|вы спросили)\s*[:\-–—]\s*)+",
    re.I,
)
# How a question asks to have a line repeated, in nine languages.
_REPEAT = re.compile(
    r"\b(?:repeat|echo|copy|say|write|type|print|quote|recite|reproduce|wiederhol\w*|schreib\w*|sag\w*|sprech\w*|r[ée]p[ée]t\w*|recopi\w*|écri\w*|dites|repit\w*|escrib\w*|diga\w*|di|"
    r"repet\w*|repita\w*|escrev\w*|ripet\w*|scriv\w*|dica|herhaal\w*|schrijf\w*|zeg\w*|повтор\w*|напиш\w*|скаж\w*)\b",
    re.I,
)


def _common(a: list[str], b: list[str], times: int = 1) -> int:
    left = Counter(b)
    return sum(min(n, times * left[w]) for w, n in Counter(a).items() if w in left)


def is_copy(question: str | None, answer: str | None) -> bool:
    """Whether the answer gives the question back and nothing more: once or several times over, with a lead-in or in
    other dress, in nearly the same words."""
    q = words(question)
    if not q or not answer:
        return False
    bare = _DRESS.sub("", answer)
    a = words(bare)
    if not a or len(a) < 0.75 * len(q):
        return False
    if 2 * len(set(q).intersection(a)) < len(set(q)):
        return False
    times = max(1, round(len(a) / len(q)))
    if _common(a, q, times) < 0.8 * max(len(a), times * len(q)) - 1e-9 and not _typos(a, q, times):
        return False
    lead, colon, line = (question or "").partition(":")
    if colon and len(words(lead)) <= 8 and _REPEAT.search(lead):
        # the line alone was asked for; the request given back with it is a copy
        if _common(a, q) - _common(a, words(line)) < max(1, len(words(lead)) // 2):
            return False
    # what goes on after the question is an answer of its own
    rest = list((Counter(a) - Counter({w: times * n for w, n in Counter(q).items()})).elements())
    return len(rest) <= max(2, 0.25 * len(a))


def _typos(a: list[str], q: list[str], times: int) -> bool:
    """Whether the words that the two don't share pair up as spellings of each other."""
    x = list((Counter(a) - Counter({w: times * n for w, n in Counter(q).items()})).elements())
    y = list((Counter({w: times * n for w, n in Counter(q).items()}) - Counter(a)).elements())
    if len(x) > 0.4 * len(a):
        return False
    by_length: dict[int, list[str]] = {}
    for v in y:
        by_length.setdefault(len(v), []).append(v)
    left = len(x), len(y)
    for w in x:
        same = (v for n in (len(w) - 1, len(w), len(w) + 1) for v in by_length.get(n, ()))
        near = next((v for v in same if sum((Counter(v) & Counter(w)).values()) >= max(len(v), len(w)) - 1), None) if len(w) > 2 else None
        if near:
            by_length[len(near)].remove(near)
            left = left[0] - 1, left[1] - 1
    return left[0] <= 0.2 * len(a) and left[1] <= 0.2 * times * len(q)


# --- refusal ---

# Phrases that decline, one language a line.
REFUSALS = [
    r"\b(?:i|we) (?:can ?not|can['’]?t|could ?n['’]?o?t|wo['n]?['’]?t|will not|am not able to|['’]m not able to|am unable to|['’]m unable to|must decline to|have to decline|decline to|refuse to|do not|don['’]t feel comfortable) (?:be able to )?(?:help|assist|answer|provide|share|discuss|respond|comply|comment|go into|do that|fulfil\w*|give|support|talk|offer|disclose|complete|continue|engage|answering|discussing|do this)",
    r"\bi (?:cannot|can['’]t|can not|won['’]t|will not) (?:with )?(?:that|this)\b|\bi['’]?(?:m| am) (?:unable|not able|not allowed|not permitted|not authori[sz]ed|not in a position|not going) to\b|\bi['’]?d (?:rather|prefer) not\b|\bi would (?:rather|prefer) not\b|\bi prefer not to\b|\bi(?:['’]ll| will| have to| must) (?:have to )?(?:pass on|decline)\b|\bi won['’]t go into\b|\bno can do\b|\bnot answering (?:this|that)\b|\boff[- ]limits\b",
    r"\b(?:beyond|outside|falls outside) (?:of )?(?:what|my|the) (?:i|scope|remit|guidelines|role|abilities|capabilities)\b|\bguidelines (?:prevent|prohibit|forbid|do not allow|don['’]t allow)|\b(?:against|violates?) (?:the|my|our) (?:policy|policies|guidelines|rules)|\b(?:conflicts?) with my (?:instructions|guidelines)|\bno answer can be given\b|\bas an? (?:ai|language model|assistant)\b.{0,60}\b(?:no opinion|not|cannot|can['’]t|unable|don['’]t)\b|\bfalls outside what i am\b|\bthat lies beyond\b",
    r"\bnicht (?:helfen|beantworten|weiterhelfen|behilflich sein|antworten|äußern|eingehen)\b|\b(?:darf|kann|möchte|werde) (?:ich )?(?:\w+ ){0,4}nicht (?:beantworten|helfen|äußern|sprechen|darauf)|\bspreche ich nicht\b|\bnicht in meinen aufgabenbereich\b|\bals (?:sprachmodell|ki)\b.{0,60}\b(?:keine|nicht)\b|\bkeine (?:meinung|auskunft)\b.{0,20}$|\blehne (?:ich )?(?:es )?ab\b|\bnicht möglich, (?:diese|ihre|auf)\b",
    r"\bne (?:peux|puis|saurais|peut|pouvons) (?:pas |malheureusement pas |donc pas )?(?:vous |y |en |le |la |l['’])?(?:aider|répondre|fournir|partager|donner|parler|discuter|traiter)|\bn['’]en parlerai pas\b|\bpréfère ne pas\b|\bsort de mon (?:champ|domaine|rôle)|\ben tant que modèle\b.{0,60}\bpas\b|\b(?:pas|ne) (?:autorisée?|en mesure|habilitée?|permis)\b|\bdois refuser\b|\bpas possible de répondre\b|\bn['’](?:ai pas le droit|est pas possible)\b",
    r"\bno (?:puedo|podemos|podr[ée]) (?:ayudar|responder|proporcionar|compartir|dar|hablar|contestar|atender)\w*|\bno me es posible\b|\bprefiero no\b|\bno (?:voy a|quiero) (?:hablar|responder|contestar|tratar)|\bfuera de (?:mis|mi) (?:funciones|competencia\w*|alcance|cometido)|\bcomo modelo de lengua\w*\b.{0,60}\bno\b|\bno (?:tengo permitido|estoy autorizad[oa]|se me permite|hablaré|hablo)\b|\bde eso no (?:hablo|voy)",
    r"\bnão (?:posso|podemos|poderei) (?:ajudar|responder|fornecer|compartilhar|partilhar|dar|falar|atender)|\bnão me é possível\b|\bprefiro não\b|\b(?:não (?:vou|quero)) (?:falar|responder|tratar)|\bfora d(?:as|os|a|o) (?:minhas?|meus?) (?:funç\w+|competênc\w+|âmbito|alcance)|\bcomo modelo de linguagem\b.{0,60}\bnão\b|\bnão (?:tenho permissão|estou autorizad[oa]|falarei|falo)\b|\bdisso (?:eu )?não falo\b|\bsobre isso (?:eu )?não (?:falo|vou)",
    r"\bnon (?:posso|possiamo|potrò) (?:aiutar\w*|rispondere|fornire|condividere|dare|parlare|soddisfare)|\bnon mi è (?:possibile|permesso|consentito)|\bpreferisco non\b|\bdi questo non (?:parlo|parlerò)|\besula dai miei\b|\bcome modello linguistico\b.{0,60}\bnon\b|\bnon (?:sono autorizzat[oa]|ho il permesso|ho opinioni|intendo parlar\w*|ne parlo|ne parlerò|voglio parlar\w*)\b|\bfuori dal(?:le)? mi[eo] (?:compiti|competenze|ambito)|\bnon (?:posso|è possibile)\b.{0,30}(?:richiesta|domanda)",
    r"\b(?:kan|mag|wil|zal) (?:ik )?(?:\w+ ){0,5}(?:niet|geen) (?:\w+ )?(?:helpen|beantwoorden|geven|bespreken|ingaan|praten)|\bgeen antwoord (?:geven|op)|\bgeen uitspraken\b|\bbuiten mijn (?:taak|taken|bevoegdheid|bereik)|\bals taalmodel\b.{0,60}\b(?:geen|niet)\b|\b(?:liever niet|daar praat ik niet|daarover praat ik niet|hier praat ik niet|ik praat daar niet|praat ik niet)|\bniet mogelijk (?:om )?(?:dit|deze|op)\b|\bdaar (?:heb|geef) ik\b.{0,30}\b(?:geen|niet)\b|\bkan ik u (?:helaas )?niet\b",
    r"\bне (?:могу|можем|смогу|вправе|имею права|готов|буду|стану) (?:\w+ ){0,4}(?:помо\w+|отвеч\w+|ответ\w+|предостав\w+|обсужд\w+|говор\w+|дел\w+|выполн\w+|мнения)|\bпредпочёл бы не\b|\bпредпочитаю не\b|\bпредпочла бы не\b|\bвыходит за рамки\b|\bкак языковая модель\b.{0,60}\bне\b|\bоб этом я говорить не\b|\bне имею (?:права|мнения)\b|\bмне не разрешено\b|\bвынужден\w* отказ\w+|\bне могу вам\b|\bне представляется возможным\b",
    # a role, a subject or a feeling given as the reason, in all of them
    r"\b(?:i|we) (?:will not|won['’]t|wo n['’]t|am not going to|['’]m not going to) be (?:able to |providing|giving|sharing|answering|discussing|helping|offering|commenting|going into)|\bnot (?:a (?:subject|topic|matter)|something|an area) (?:that )?i (?:can |could |will )?(?:engage|discuss|cover|talk|speak|help|deal|touch|comment|assist|go into|get into|address|do\b)|\b(?:do not|don['’]t) feel comfortable\b|\b(?:am not|['’]m not) comfortable (?:with |giving|providing|sharing|answering|discussing|helping)|\b(?:inappropriate|not appropriate|improper) for me to\b|\bmy (?:role|remit|scope|purpose|instructions|guidelines) (?:does not|doesn['’]t|do not|don['’]t) (?:cover|include|extend|allow|permit)|\b(?:must|have to|need to) refrain from\b",
    r"\b(?:wäre|ist) (?:für mich )?(?:unangebracht|unpassend|nicht angemessen)\b.{0,30}\bmich\b|\bmeine (?:rolle|aufgabe) (?:umfasst|deckt|erstreckt)\b.{0,40}\bnicht\b|\bkein thema, (?:über|auf|zu|mit) (?:das|dem)\b.{0,5}\bich\b|\bfühle mich (?:dabei )?nicht wohl\b|\b(?:serait|est) (?:inapproprié|déplacé) (?:de ma part|que je|pour moi)|\bmon rôle ne (?:couvre|comprend|s['’]étend)|\bpas un sujet (?:que|dont|sur lequel) j|\bne me sens pas à l['’]aise\b|\b(?:sería|es) (?:inapropiado|inadecuado) (?:que yo|por mi parte|para mí|de mi parte)|\bmi (?:función|papel|rol) no (?:abarca|incluye|cubre)|\bno es un tema (?:que|del que|sobre el que)\b|\bno me siento cómod[oa]\b",
    r"\b(?:seria|é) (?:inapropriado|inadequado) (?:da minha parte|eu|para mim)|\b(?:o )?meu papel não (?:abrange|inclui|cobre)|\bnão é um (?:assunto|tema) (?:que|do qual|sobre o qual)\b|\bnão me sinto (?:à vontade|confortável)|\b(?:sarebbe|è) (?:inopportuno|inappropriato) (?:che io|da parte mia|per me)|\b(?:il )?mio ruolo non (?:copre|comprende|include|prevede)|\bnon è un argomento (?:che|di cui|su cui)\b|\bnon mi sento a mio agio\b|\bongepast (?:van mij|als ik|voor mij|zijn dat ik)|\bmijn rol (?:omvat|dekt|strekt)\b.{0,40}\bniet\b|\bgeen onderwerp (?:waar|dat ik)|\bvoel (?:ik )?me (?:er |daar )?niet (?:prettig|comfortabel|gemakkelijk)\b|\bнеуместно (?:с моей стороны|мне)|\bс моей стороны (?:было бы )?неуместно\b|\bмоя роль не (?:охватывает|включает|предполагает)|\bне та тема\b|\bмне некомфортно\b|\bне чувствую себя комфортно\b",
]
_REFUSAL = re.compile("|".join(f"(?:{x})" for x in REFUSALS), re.I)
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")
#: Words beside the refusing sentences that a refusal may have: an offer of other help, a farewell.
POLITE = 26


def is_refusal(answer: str | None) -> bool:
    """Whether the answer declines and gives nothing: at least one sentence refuses, and what stands before and after
    it is too short, or too much of the polite kind, to be an answer."""
    if not answer:
        return False
    body = _MARKUP.sub(" ", answer)
    if not _REFUSAL.search(body):
        return False
    rest = [s for s in _SENTENCE.split(body) if s and s.strip() and not _REFUSAL.search(s)]
    real = [s for s in rest if not _POLITE.search(s)]
    n = sum(len(WORD.findall(s)) for s in real)
    return n <= 8 or (n <= POLITE and len(real) <= 1 and len(rest) > len(real))


# How an assistant turns to something else, thanks, greets, or names somebody else to ask.
_POLITE = re.compile(
    r"\b(?:hello|hi|hmm|sorry|thank(?:s| you)|unfortunately|regrettably|apolog\w+|i understand|please (?:consult|contact|ask|see|let me know)|perhaps|maybe|something (?:else|different)|anything else|feel free|is there|let['’]s talk|happy to|consult|qualified|"
    r"leider|tut mir leid|entschuldig\w*|danke|bitte|vielleicht|fachkraft|fragen sie|désolée?|merci|malheureusement|adressez|peut-être|veuillez|lo siento|gracias|lamentablemente|consulte|quizás?|por favor|desculpe|obrigad[oa]|infelizmente|talvez|"
    r"mi dispiace|grazie|purtroppo|si rivolga|forse|prego|het spijt|helaas|bedankt|misschien|vraag het|alstublieft|извините|простите|спасибо|к сожалению|увы|обратитесь|пожалуйста|возможно)\b",
    re.I,
)

# --- truncated ---

_END = re.compile(r"[.!?…。！？][\"'”’»)\]*_`]*$")
_ITEM = re.compile(r"^\s*(?:[-*+•–·]|\d{1,3}[.)])\s*")
_NUMBERED = re.compile(r"^\s*\d{1,3}[.)]\s*")
# Words that open something and so can't end it, in eight languages.
OPENING = set(
    """a an the and or but nor of to in on at by for from with without into onto over under between behind before after during until because although though while when where
    which who whose that than as if so yet is are was were be been has have had can could must should would will may some both neither either each every no its their his her my your only
    der die das den dem des ein eine einen einem einer und oder aber von zu zum zur im am an auf aus bei mit nach seit vor hinter zwischen weil dass obwohl wenn ob ist wird nicht kein keine sich als
    le la les un une des du de et ou mais dans sur pour par avec sans chez entre derrière que qui parce bien ne se au aux ce cette
    el los las una unos del y o pero en con sin por para desde porque aunque cuando su sus al lo
    o os as um uma do da dos das e mas em no na nos nas com sem porque embora ao à pelo pela seu sua
    il lo i gli uno dello della dei degli ed ma nel nella sul sulla con senza per tra fra perché anche che non si al alla suo
    het een en of maar van naar op met zonder uit bij voor na tussen achter omdat hoewel als dat die niet geen zich te er
    и или но в во на с со к ко у о об из за под над для без между потому хотя что как не ни по от до при уже""".split()
)
_YES_NO = set("yes no ja nein oui non si sí sì sim não nee да нет".split())
_PAIRS = {"(": ")", "[": "]", "{": "}", "«": "»", "“": "”", "„": "“"}


_BRACKETS = re.compile("[](){}[«»“”„]")


def _unclosed(text: str) -> bool:
    if text.count("```") % 2:
        return True
    prose = text
    stack: list[str] = []
    for m in _BRACKETS.finditer(prose):
        c = m[0]
        if c == "“" and stack and stack[-1] == "„":
            stack.pop()
        elif c in "([{«“„":
            stack.append(c)
        elif c in ")]}»”" and stack:
            top = stack[-1]
            if _PAIRS[top] == c or (top == "„" and c == "”"):
                stack.pop()
    if stack:
        return True
    if '"' in prose and re.sub(r"\d\s*\"", "", prose).count('"') % 2 and prose.count('"') % 2:
        return True
    return prose.count("**") % 2 == 1


def _value(line: str) -> bool:
    """Whether a line is a bare value: names, a number with a unit, a code, a word or two."""
    w = WORD.findall(line)
    if not w:
        return False
    if re.fullmatch(r"[A-Z]{1,6}[- ]?\d+\w*", line):
        return True
    if w[-1].lower() in OPENING and not w[-1][0].isupper() and len(w) > 1:
        return False
    if len(w) == 1:
        return w[0].lower() not in OPENING
    if any(c.isdigit() for c in line) and len(w) <= 4 and w[0].lower() not in OPENING:
        return True
    if len(w) <= 5 and all(x[0].isupper() or x[0].isdigit() or len(x) <= 3 and x.lower() in OPENING for x in w) and w[0].lower() not in OPENING:
        return True
    return len(w) <= 3 and not any(x.lower() in OPENING for x in w) and not w[0][0].isupper()


def is_truncated(answer: str | None) -> bool:
    """Whether the answer stops before its last sentence, list item, list or block is complete."""
    if not answer:
        return False
    text = re.sub(r"<think>.*?</think>", " ", answer, flags=re.S | re.I).strip() if "<" in answer else answer.strip()
    if not WORD.search(text) or text.lower() in _YES_NO:
        return False
    if "<think" in text and re.search(r"<think>(?!.*</think>)", text, re.S | re.I):
        return True
    if text.endswith(("...", "…", ",", ";", ":", "-", "–", "—", "(", "[", "{", "/", "&", "|-")) and not text.endswith("```"):
        return not (text.endswith("|") or re.search(r"\n\|[^\n]*\|$", text))
    if _unclosed(text):
        return True
    if text.endswith(("```", "}", "]")) or re.search(r"\|\s*$", text):
        return False
    lines = [x for x in text.split("\n") if x.strip()]
    last = lines[-1].strip()
    item = bool(_ITEM.match(last)) and len(lines) > 1
    body = _ITEM.sub("", last).strip() if item else last
    if item and not WORD.search(body):
        return True
    if _END.search(body):
        # an ordinal that begins an item, or a sentence of one opening word, is no end
        return bool(re.fullmatch(r"\d{1,3}[.)]", body)) and len(lines) > 1
    if body[-1] in "\"”»’'*_`)" and len(WORD.findall(body)) > 0:
        return False
    w = WORD.findall(body)
    if item:
        others = [_ITEM.sub("", x).strip() for x in lines[:-1] if _ITEM.match(x)]
        if others and sum(bool(_END.search(x)) for x in others) * 2 > len(others):
            return True
        if _fragment(w, others):
            return True
        return len(w) > 8 and not others
    if len(lines) == 1 or len(w) > 5:
        return not _value(body)
    return not _value(body)


def _fragment(w: list[str], others: list[str]) -> bool:
    """Whether a list item without a full stop breaks off: it ends with a word that opens something, or within one."""
    if not w:
        return True
    last = w[-1].lower()
    return last in OPENING and not w[-1].isupper() or len(last) <= 2 and not last.isdigit()


# --- other language ---

# Frequent words of eight languages, none of them in two lists of the pairs that are easily confused.
FUNCTION_WORDS = {
    "en": "the and of is was were are to which that with from than only this what how did does not you your their should would could for it be as by no at although but on had",
    "de": "der die das und ist nicht ein eine einen aus dem den mit sich wie warum weil bei auf auch wird sie ich für zum zur hat niemand kann gibt",
    "fr": "de le les des est une et dans du pour que qui pas pourquoi parce au aux ne sur avec plus il elle vous cette mais quand comment ce l d qu",
    "es": "de el los las una y por que para con su del pero está porque más cuando cómo qué hay se dice es usted puede nadie aunque lo al no",
    "pt": "de os as uma um não que para com do da dos das em no na por mas porque você pode mais há quando como é ao diz embora ninguém foram o",
    "it": "il gli della di che non è un una per perché con del dei nel anche ma quando sono ci dice più al lo alla nessuno mi",
    "nl": "de het een en van niet dat is uit op te voor met zijn waarom hoe als er heeft ook maar zegt niemand omdat bij naar u kunt",
    "ru": "и в не на что как из но с по у это для к за при уже никто от если когда почему вы",
}
_FUNCTION: dict[str, list[str]] = {}
for _lang, _list in FUNCTION_WORDS.items():
    for _w in _list.split():
        _FUNCTION.setdefault(_w, []).append(_lang)
_ASKS = {
    "en": r"english|englisch\w*|anglais\w*|inglés\w*|inglês\w*|inglese\w*|engels\w*|английск\w*",
    "de": r"german|deutsch\w*|allemand\w*|alemán\w*|alemão\w*|tedesc\w+|duits\w*|немецк\w*",
    "fr": r"french|französisch\w*|français\w*|francés\w*|francês\w*|francese\w*|frans\w*|французск\w*",
    "es": r"spanish|spanisch\w*|espagnol\w*|español\w*|espanhol\w*|spagnol\w+|spaans\w*|испанск\w*|castellano",
    "pt": r"portuguese|portugiesisch\w*|portugais\w*|portugués\w*|português\w*|portoghese\w*|portugees\w*|португальск\w*",
    "it": r"italian|italienisch\w*|italien\w*|italiano\w*|italiaans\w*|итальянск\w*",
    "nl": r"dutch|niederländisch\w*|néerlandais\w*|neerland[eé]s\w*|neerlandês\w*|holandês\w*|holandés\w*|olandese\w*|nederlands\w*|нидерландск\w*|голландск\w*",
    "ru": r"russian|russisch\w*|russe\w*|ruso\w*|russo\w*|русск\w*",
}
_ASKED = {lang: re.compile(rf"\b(?:{x})\b", re.I) for lang, x in _ASKS.items()}
_LETTERS = re.compile(r"[^\W\d_]")
_CYRILLIC = re.compile(r"[Ѐ-ӿ]")


def language_scores(text: str | None) -> dict[str, float]:
    """How much of each language a text's script and most frequent words speak for; empty if neither tells."""
    if not text:
        return {}
    body = re.sub(r"```.*?(?:```|$)", " ", text, flags=re.S) if "```" in text else text
    if not body.isascii():
        cyrillic = len(_CYRILLIC.findall(body))
        if cyrillic and cyrillic > 0.4 * len(_LETTERS.findall(body)):
            return {"ru": 99.0}
    score: dict[str, float] = {}
    for w in words(body):
        langs = _FUNCTION.get(w)
        if langs:
            for x in langs:
                score[x] = score.get(x, 0) + 1 / len(langs)
    return score


def is_other_language(question: str | None, answer: str | None) -> bool:
    """Whether the answer is mainly in another language than the question, which doesn't ask for that language."""
    a = language_scores(answer)
    if not a or max(a.values()) < 2:
        return False
    q = language_scores(question)
    if not q:
        return False
    asked = [lang for lang, x in _ASKED.items() if x.search(question or "")]
    mine = max(sorted(q), key=q.__getitem__)
    theirs = max(sorted(a), key=a.__getitem__)
    if theirs == mine or q[mine] - q.get(theirs, 0) < 0.9 or a[theirs] - a.get(mine, 0) < max(1.6, 0.05 * len(words(answer))):
        return False
    return all(a[theirs] - a.get(lang, 0) > 1 for lang in asked)


# --- on tables ---

_RULES = (("empty", lambda q, a: is_empty(a)), ("question_copy", is_copy), ("refusal", lambda q, a: is_refusal(a)), ("truncated", lambda q, a: is_truncated(a)), ("other_language", is_other_language))


def defects(question: str | None, answer: str | None) -> list[str]:
    """All defects of a pair, in the order of the rules; an empty answer has no other."""
    if is_empty(answer):
        return ["empty"]
    return [name for name, rule in _RULES[1:] if rule(question, answer)]


def pair_defects(df: DataFrame, id_column: str, question: str = "question", answer: str = "answer") -> DataFrame:
    """Rows (id, defect, rank) for every defect of every row; rank 0 is the rule that came first.

    A null or blank answer is ``empty``. Without a question there is no copy and no other language. Rows that repeat an
    id each have their rows. An empty table gives no rows. Other columns are ignored. No shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, q, a in zip(pdf["id"].tolist(), pdf["q"].tolist(), pdf["a"].tolist()):
                for k, d in enumerate(defects(q if isinstance(q, str) else None, a if isinstance(a, str) else None)):
                    rows.append((i, d, k))
            yield pd.DataFrame(rows, columns=["id", "defect", "rank"])

    picked = df.select(F.col(id_column).cast("long").alias("id"), F.col(question).alias("q"), F.col(answer).alias("a"))
    return picked.mapInPandas(run, "id long, defect string, rank int")
