"""Defective question-answer pairs, by labelling functions and a label model.

Each defect has several noisy labelling functions that vote 1 (has it), 0 (hasn't) or -1 (abstains). Votes are reduced
to counts of vote patterns (at most 3 ** m a defect, so what reaches the driver is bounded whatever the table's size);
an expectation-maximisation fits the prior and each function's accuracies on those counts; the posterior of each
pattern goes back to the rows. A pair keeps every defect whose posterior exceeds the defect's cutoff.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFECTS = ("empty", "truncated", "refusal", "copy", "other_language")
#: Functions a defect.
N_VOTES = 4
#: Cutoffs of the posterior, one a defect; ``best_cutoff`` of the held-out pairs (``tests/llm/test_pairs.py``) lies at 0.5 but for
#: other_language, whose held-out posteriors leave any cutoff between 0.02 and 0.86 as good.
CUTOFFS = dict.fromkeys(DEFECTS, 0.5)

# Stand-ins for a missing value, and function words by language.
STAND_INS = set("""n/a na n.a. none null nil nan undefined missing tbd tba todo - -- --- . .. ... … ? ?? [] {} () "" '' <na> <null> #n/a keine
k.a. s/d ninguno ninguna aucun""".split())
FUNCTION_WORDS = {
    "en": """the is are was were of in on at by for from with as and or but it its this that there these which what who when where how has
    have had does do did not no be been will would must can page gives states names says according from about you asked i to""".split(),
    "de": """der die das den dem des ein eine einen einem ist sind war im in am auf aus bei mit nach von vom zum zur und oder aber nicht
    keine kein wird werden wurde steht lautet laut gilt auch für über wie welche welcher sich dass weil ich seite zwar""".split(),
    "es": """el la los las un una es son fue en de del al con por para según y o pero no se que qué cuál como también este esta año
    página documento consta respuesta vale viene porque su está antes debe
    corresponde indica hora fecha anual mensual informe""".split(),
    "fr": """le la les un une des du de est sont dans sur au aux avec par pour selon et ou mais ne pas se que qui quel quelle ce cette
    c'est d'après page document réponse il elle vaut aussi rien d'autre indique comme s'agit""".split(),
    "it": """il lo la gli un una è sono nel della del di da con per secondo e o ma non che quale questo questa documento pagina anche
    come si tratta risulta vale anno che""".split(),
    "pt": """o os as um uma é são no na do da de em com por para segundo e ou mas não que qual este esta documento
    página também trata-se mostra como vale ano próximo""".split(),
    "nl": """de het een is zijn was in op aan bij met naar van en of maar niet geen dat die wat welke volgens ook voor pagina staat gaat om zoals antwoord""".split(),
}
_FW = {k: frozenset(v) for k, v in FUNCTION_WORDS.items()}
_HANGING = frozenset(
    """the a an of in on at by for from with as and or but is are was were that which to its it must be has have than because when if
    der die das den dem des ein eine ist sind und oder auf mit von vom im zum zur dass weil el la los las un una es de del en y o que por para
    le les des du et ou est page seite página""".split()
)
_FILE = re.compile(r"\S+\.(?:pdf|docx?|txt|md|html?)\b(?:,?\s*(?:p|S|page|Seite|página)\.?\s*\d+)?", re.I)
_CITE = re.compile(r"\[[^\]\n]*\]|\([^()\n]*\.(?:pdf|docx?|txt|md)\b[^()\n]*\)")
_WORDS = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_LETTERS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_END = re.compile(r"[.!?。！？।؟…:;][\"'”’»)\]*_\s]*$")
_CLOSED = re.compile(r"[\])\"”’»*_]\s*$")
_LABEL = re.compile(r"(?:question|answer|q|a|frage|antwort|f|pregunta|respuesta|r|p)\s*[:.)]\s*", re.I)
_SAME_START = re.compile(r"^(?:question|answer|q|a|frage|antwort|pregunta|respuesta|r)\s*:\s*", re.I | re.M)
# First-person refusals and impersonal ones, by language.
_REFUSE_STRONG = re.compile(
    r"\b(?:i(?:'m| am)? (?:sorry, (?:but )?i )?(?:can(?:'t|not| not)|won(?:'t)|will not|must decline|decline|refuse|am not able|am unable|'m not able|'m unable|"
    r"am not allowed|may not|would rather not|prefer not|have no way|do not wish|don't wish)|not able to (?:answer|help|say|share|discuss)|i'd rather not|"
    r"cannot comply|can't (?:help|assist|answer|share|discuss)|cannot (?:help|assist|answer|share|discuss)|"
    r"not (?:something|a thing) i (?:can|may|will)|(?:do|does) not (?:allow|permit) me|outside (?:of )?what i (?:may|can)|"
    r"keep such .{0,40}to myself|(?:goes?|go) against my|against my (?:instructions|guidelines|policy)|no comment|request declined|"
    r"ich (?:leider |dazu )?(?:nicht|keine) .{0,30}(?:beantworten|helfen|sagen|geben|auskunft)|(?:kann|darf|möchte) ich (?:leider |dazu |dabei |hier )*(?:nicht|keine)|"
    r"no puedo (?:ayudar|responder|contestar|compartir|decir)|no me está permitido|prefiero no|me niego|no debo (?:responder|hablar)|"
    r"je ne (?:peux|puis|souhaite|veux) pas|je refuse|je préfère ne pas)\b",
    re.I,
)
#: A refusal has one of these words.
_REFUSE_HINT = frozenset("""can't cannot not won't don't doesn't decline declined declining refuse rather prefer allow permit outside keep against stop
no nicht keine kein puedo permitido prefiero niego debo peux puis refuse préfère veux souhaite unable sorry instructions
lack without confidential classified restricted off ai n'ai""".split())
_REFUSE_VERB = re.compile(r"\b(?:answer|help|assist|share|discuss|comment|comply|talk about|say|disclose|declin\w+|beantworten|helfen|auskunft|ayudar|responder|contestar|répondre|aider|open private|private)\b", re.I)
_REFUSE_NOT = re.compile(r"\b(?:not|can't|cannot|won't|no|decline\w*|rather not|prefer not|against|unable|outside|nicht|keine|leider|siento|refuse|pas|myself|stop)\b", re.I)
#: What declines in any words: inability, permission, secrecy.
_REFUSE_BROAD = re.compile(
    r"\b(?:(?:un|not )able to (?:provide|give|tell|reveal|disclose|access|answer|help|share|assist)|(?:can(?:'t|not| not)|won't|will not|may not|must not) (?:provide|give|tell|reveal|disclose|access|answer|help|share|assist|be (?:shared|disclosed|discussed|given))|"
    r"(?:do(?:es)?(?: not|n't)) have (?:any )?(?:access|permission|the right|authori\w+)|(?:lack|without) (?:the |any )?(?:permission|access|authori\w+|clearance)|(?:is|are|be) (?:strictly )?(?:confidential|classified|restricted|off limits)|"
    r"not (?:permitted|allowed|authori[sz]ed|at liberty|in a position) to|as an ai|(?:nicht|keine?) (?:\w+ )?(?:erlaubt|befugt|berechtigt|berechtigung|zugriff)|no (?:estoy autorizad\w|tengo (?:permiso|acceso))|je n'ai pas (?:accès|le droit))\b",
    re.I,
)
#: Words, in a line of words, whose letters and parts tell a language.
_MARKS = {
    "de": re.compile(r"[^ ]*(?:[äöüß]|sch)[^ ]*|[^ ]*(?:ung|keit|heit|lich)(?= |$)"),
    "es": re.compile(r"[^ ]*[ñáíóú][^ ]*|[^ ]*(?:idad|mente)(?= |$)|(?:^|(?<= ))ll[^ ]*"),
    "fr": re.compile(r"[^ ]*[çœêèûâ][^ ]*|(?:^|(?<= ))(?:l|d|qu|n|s|c)['’][^ ]*|[^ ]*(?:eux|oir)(?= |$)"),
    "en": re.compile(r"(?:^|(?<= ))(?:th|wh)[^ ]*|[^ ]*(?:ght[^ ]*|(?:ing|ould)(?= |$))"),
}
_FIRST = re.compile(r"\b(?:i|i'm|i'd|me|my|myself|ich|mir|yo|me|puedo|siento|prefiero|je|nous|we|our)\b", re.I)


_INVISIBLE = re.compile(r"[​-‏⁠﻿­]")


def _plain(text: str | None) -> str:
    """Text without invisible characters and outer white space."""
    return _INVISIBLE.sub("", text).strip() if text else ""


def _numbers(text: str) -> set[str]:
    return set(re.findall(r"\d[\d.,:]*\d|\d", text))


def _core(text: str) -> list[str]:
    """Words for comparing an answer with its question."""
    return [w.lower() for w in _WORDS.findall(text)]


def _outside(text: str, low: str, by: str) -> str:
    """``text`` without citations and file names, ``by`` in place of each; ``low`` is the text in lower case."""
    if "[" in text or "(" in text:
        text = _CITE.sub(by, text)
    return _FILE.sub(by, text) if any(e in low for e in (".pdf", ".doc", ".txt", ".md", ".htm")) else text


@lru_cache(maxsize=1 << 14)
def _asked(question: str) -> tuple[str, ...]:
    return tuple(_core(question))  # questions recur


def _alike(a: str, b: str) -> float:
    """Share of the letter trigrams of two texts that both have, blanks and punctuation aside."""
    x, y = ({t[i:i + 3] for i in range(max(1, len(t) - 2))} for t in ("".join(_core(a)), "".join(_core(b))))
    return len(x & y) / len(x | y)


def _script(word: str) -> str:
    o = ord(word[0])
    for below, name in ((0x370, "latin"), (0x400, "el"), (0x530, "ru"), (0x590, "hy"), (0x600, "he"), (0x780, "ar"), (0x980, "hi"), (0x3040, "other"), (0x3100, "ja"), (0xA000, "zh"), (0xAC00, "other"), (0xD7B0, "ko")):
        if o < below:
            return name
    return "other"


@lru_cache(maxsize=4096)
def spoken(text: str) -> dict[str, int]:
    """Signs of each language in a text without citations: function words, or letters of a script that isn't Latin."""
    words = _LETTERS.findall(text)
    scripts: dict[str, int] = {}
    for w in words:
        s = _script(w)
        if s != "latin":
            scripts[s] = scripts.get(s, 0) + len(w)
    if "ja" in scripts and "zh" in scripts:
        scripts["ja"] += scripts.pop("zh")
    if scripts and max(scripts.values()) >= 4:
        return scripts
    low = [w.lower() for w in words]
    hits = {k: sum(map(fw.__contains__, low)) for k, fw in _FW.items()}
    return {k: v for k, v in hits.items() if v}


def language(text: str) -> str | None:
    """The language with most signs; None for bare values and where two or more share the lead."""
    hits = spoken(text)
    best = [k for k, v in hits.items() if v == max(hits.values())]
    return best[0] if len(best) == 1 else None


def _bare(answer: str) -> bool:
    """Whether the answer is a value, a name or label-and-value lines, and no sentence."""
    lines = [x for x in re.split(r"\n+", _outside(answer, answer.lower(), "")) if _WORDS.search(x)]
    for line in lines:
        line = line.strip(" -*•\t")
        label, colon, value = line.rpartition(": ")
        low = [w for w in _LETTERS.findall(value if colon else line) if w.islower() and w not in ("and", "ms", "und", "y", "et", "p", "of", "the", "page", "am", "pm")]
        if low or (colon and not value.strip()):
            return False
        if colon and len(label) > 80:
            return False
        words = _LETTERS.findall(line)
        if words and words[-1] in _HANGING and line.endswith(words[-1]):
            return False
    return True


#: A value is said to be missing.
_MISSING = re.compile(
    r"\b(?:no (?:answer|such|value|information)|not (?:in|given|stated|found|mentioned|specified)|unanswerable|is blank|nicht (?:\w+ ){0,3}angegeben|no consta)\b", re.I
)
#: A note without end mark that is whole: it ends with the word that says so, or names no more than where the value was sought.
_NOTE = re.compile(
    r"(?:[^.!?\n]*\b(?:not (?:given|stated|specified|mentioned)|(?:field|value) is blank)|unanswerable|not found|"
    r"not (?:in|given in|stated in|found in|mentioned in|specified in) (?:(?:the|this|that|any) )?(?:documents?|texts?|pages?|files?|sources?|context|records?)|"
    r"(?:[^.!?\n]*\b)?nicht (?:\w+ ){0,3}angegeben|(?:[^.!?\n]*\b)?no consta(?: en (?:el|la|los|las) (?:documentos?|textos?|páginas?))?)", re.I
)
#: What only a refusal says.
_DECLINES = re.compile(r"\b(?:help|assist|share[ds]?|discuss\w*|comment|comply|talk about|disclose[ds]?|declin\w+|refuse[ds]?|ayudar|responder|contestar|helfen|auskunft|aider|répondre)\b", re.I)
_SENTENCE = re.compile(r"[.!?。！？؟]\s+(?=\S)")


def _common() -> frozenset[str]:
    from siltra.llm.tokenizing import common_words

    return common_words()


def votes(question: str | None, answer: str | None) -> list[int]:
    """N_VOTES votes for each of DEFECTS, in order."""
    q, a = _plain(question), _plain(answer)
    words, asked = _core(a), list(_asked(q))
    alnum = any(c.isalnum() for c in a)
    low = a.lower()
    # empty
    stand_in = low in STAND_INS or low.strip(" .\"'") in STAND_INS
    unsure = -1 if stand_in else 0  # what looks at characters can't tell a stand-in from a value
    empty = [1 if not a else unsure, 1 if not alnum else unsure, 1 if stand_in or not a else -1 if not alnum else 0, 1 if not alnum or stand_in else 0]
    if not alnum or stand_in:  # nothing is said: it has nothing of the question, and the other functions have nothing to judge
        return empty + [-1] * (2 * N_VOTES) + [0] * N_VOTES + [-1] * N_VOTES
    # copy: nothing but the question's words, labels aside
    said, once = set(words), set(asked)
    n = len(asked)
    covered = len(once & said) / len(once) if n else 0
    copy = [0] * N_VOTES
    if covered >= 0.8:
        own = _core(_SAME_START.sub("", a))
        times = len(own) / n
        repeats = len(own) >= n and len(own) % n == 0 and own == asked * (len(own) // n)
        extra = sum(w not in once for w in own)
        copy = [
            1 if repeats else 0,
            1 if extra == 0 and covered >= 0.9 and times >= 0.9 else 0,
            1 if covered >= 0.95 and extra <= max(1, len(own) // 12) and times >= 0.9 and not _numbers(a) - _numbers(q) else -1,
            1 if (alike := _alike(_SAME_START.sub("", a), q)) >= 0.9 else 0 if alike < 0.8 else -1,
        ]
    # refusal
    outside = _outside(a, low, " ")
    hint = not _REFUSE_HINT.isdisjoint(words)
    asked_low = q.lower()
    new = lambda m: bool(m) and m[0].lower() not in asked_low  # noqa: E731  what the question says itself declines nothing
    strong = hint and new(_REFUSE_STRONG.search(outside))
    soft = hint and bool(said - once) and bool(_REFUSE_NOT.search(outside) and _REFUSE_VERB.search(outside) and _FIRST.search(outside))
    broad = hint and new(_REFUSE_BROAD.search(outside))
    valued = outside != a or bool(_numbers(a) - _numbers(q))
    missing = bool(_MISSING.search(a))
    note = missing and bool(_NOTE.fullmatch(a))  # every note says that a value is missing
    not_given = (
        missing and (note or bool(_END.search(a))) and not _FIRST.search(a) and not _SENTENCE.search(outside)
        and not _DECLINES.search(a) and not _REFUSE_STRONG.match(outside.lstrip())
    )
    refusal = [
        1 if strong else -1 if broad else 0,
        1 if soft and not valued else 0 if not broad else -1,
        0 if valued else 1 if broad else -1,
        1 if (strong or broad) and not valued else 0 if not (strong or soft) else -1,
    ]
    if not_given:  # one whole sentence that isn't in the first person: its wording tells nothing about refusals
        refusal = [-1] * N_VOTES
    # truncated
    tail = a.rstrip("*_ \t\n")
    body = _CITE.sub("", tail).rstrip()
    last = re.split(r"\n+", tail)[-1]
    ended = bool(_END.search(tail)) or (bool(_END.search(body)) and body != tail)
    file_end = bool(re.search(r"(?:\.(?:pdf|docx?|txt|md)(?:,?\s*(?:p|S|page|Seite|página|ページ)\.?\s*\d+)?)[\])\"”*\s]*$", tail, re.I))
    open_bracket = tail.count("[") > tail.count("]") or tail.count("(") > tail.count(")") and not re.match(r"^\s*\w\)", tail)
    lowers, hangs, is_bare = True, False, None
    if not ended or tail.endswith(","):
        lowers = any(w.islower() for w in _LETTERS.findall(last))
        final = _LETTERS.findall(tail)[-1:] or [""]
        hangs = tail.endswith((",", "(", "[", "-", "–")) or (final[0].lower() in _HANGING and tail.endswith(final[0]))
        is_bare = _bare(a)
    comma = tail.endswith(",")
    whole = (ended and not open_bracket) or note or (bool(is_bare) and not hangs and not open_bracket)
    cited = bool(re.search(r"\]\s*$", tail)) or file_end
    truncated = [
        1 if not whole and not cited and (lowers or not is_bare) else 0,
        1 if hangs and not (ended and not comma) else 0 if ended or cited else -1,
        1 if open_bracket and not ended else -1,
        0 if whole or cited else 1,
    ]
    if words[-3:] == asked[-3:] and not hangs:  # it ends where the question ends: that tells nothing
        truncated = [-1] * N_VOTES
    # other language: judged by the words that aren't the question's own
    asked_in = language(q) or "en"
    bare = [w.strip(".,;:?!()\"'“”¿¡") for w in outside.split()]
    own = [w for w in bare if w.lower() not in once]
    hits = spoken(" ".join(own))
    rival = max((k for k in hits if k != asked_in), key=lambda k: hits[k], default=None)
    lead = hits[rival] - hits.get(asked_in, 0) if rival else 0
    foreign = rival is not None and rival not in _FW
    low_words = [w for w in own if w.islower()]
    line = " ".join(low_words)
    marks = {k: len(m.findall(line)) for k, m in _MARKS.items()}
    mark = max((n for k, n in marks.items() if k != asked_in), default=0)
    plain = [w for w in low_words if len(w) > 3 and w.isalpha()]
    known = sum(w in _common() for w in plain) / len(plain) if len(plain) >= 3 else None
    by_words = -1
    if known is not None and asked_in == "en":
        by_words = 1 if known < 0.4 else 0 if known > 0.7 else -1
    elif known is not None:
        by_words = 1 if known > 0.8 and len(plain) >= 4 else 0 if known < 0.5 and rival in (None, "en") else -1
    if by_words < 0 and rival and asked_in in _FW and len(low_words) > 3 and not any(w in _FW[asked_in] for w in low_words):
        by_words = 1  # not one word that the question's language can hardly do without
    other = [
        1 if lead >= 2 else 0 if lead <= 0 else -1,  # function words, or another script's letters
        1 if foreign and lead >= 4 else -1 if hits else 0,  # another script
        1 if mark >= 2 and not marks.get(asked_in) else 0 if not mark and (rival is None or rival in _MARKS and len(low_words) > 5) else -1,  # letters and word parts
        by_words,  # words that a mostly English vocabulary has; words of the question's language at all
    ]
    if not foreign and (_bare(a) if is_bare is None else is_bare):  # values and names have no language
        other = [0] * N_VOTES
    return empty + truncated + refusal + copy + other


# ---- label model ----------------------------------------------------------------------------------------------------


def fit_label_model(patterns: dict[tuple[int, ...], int], steps: int = 50, prior: float = 0.03, strength: float = 20.0) -> dict[tuple[int, ...], float]:
    """Posterior of each vote pattern under a two-class model with independent functions.

    EM over the pattern counts. Beta priors of weight ``strength`` (a function that votes is right nine times in ten;
    one row in thirty has the defect) keep the classes from swapping and rare defects from vanishing.
    """
    if not patterns:
        return {}
    keys = sorted(patterns)
    x = np.array(keys)  # (patterns, functions)
    n = np.array([patterns[k] for k in keys], dtype=float)
    m = x.shape[1]
    pi = prior
    hit = np.full((2, m), 0.0)  # hit[c, j]: chance that function j votes c when the class is c and it votes
    hit[:] = 0.9
    post = np.zeros(len(keys))
    for _ in range(steps):
        like = np.zeros((2, len(keys)))
        for c in (0, 1):
            for j in range(m):
                p = np.where(x[:, j] < 0, 1.0, np.where(x[:, j] == c, hit[c, j], 1 - hit[c, j]))
                like[c] += np.log(p)
        odds = math.log(pi) - math.log(1 - pi) + like[1] - like[0]
        new = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
        pi = float((n @ post + strength * prior) / (n.sum() + strength))
        for c, w in ((0, n * (1 - post)), (1, n * post)):
            for j in range(m):
                spoke = x[:, j] >= 0
                right = w[spoke & (x[:, j] == c)].sum()
                hit[c, j] = np.clip((right + 0.9 * strength) / (w[spoke].sum() + strength), 0.55, 0.999)
    return dict(zip(keys, post.tolist()))


def best_cutoff(posteriors: list[float], truth: list[bool]) -> float:
    """The cutoff of highest F1 on labelled rows: the middle of the widest gap between posteriors that gives it."""
    if not posteriors:
        return 0.5
    levels = sorted({0.0, *posteriors, 1.0})
    if not any(truth):
        return (max(posteriors) + 1) / 2

    def f1(cut: float) -> float:
        hit = sum(t and p > cut for p, t in zip(posteriors, truth))
        return 2 * hit / max(1, sum(truth) + sum(p > cut for p in posteriors))

    gaps = [(f1((a + b) / 2), b - a, (a + b) / 2) for a, b in zip(levels, levels[1:])]
    return max(gaps)[2]


def pairs_of(query_results: DataFrame, questions: DataFrame) -> DataFrame:
    """(record_set, row_id, q, a) of both tables; repeated rows stay, null ids are left out."""
    a = query_results.select(F.lit("query_results").alias("record_set"), F.col("result_id").alias("row_id"), F.col("question").alias("q"), F.col("answer").alias("a"))
    b = questions.select(F.lit("questions").alias("record_set"), F.col("question_id").alias("row_id"), F.col("q"), F.col("expect").alias("a"))
    return a.unionByName(b).where("row_id is not null")


def vote_patterns(pairs: DataFrame) -> DataFrame:
    """(record_set, row_id, pattern): the votes as a string of digits, ``2`` for an abstention. One pass, no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _common()  # without a vocabulary no row is judged, whether it needs the words or not
        for b in batches:
            out = ["".join("2" if v < 0 else str(v) for v in votes(q, a)) for q, a in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["record_set", "row_id", "pattern"])

    return pairs.select("record_set", F.col("row_id").cast("long"), "q", "a").mapInArrow(run, "record_set string, row_id long, pattern string")


def posteriors(patterns: DataFrame) -> DataFrame:
    """(defect, part, posterior) of each vote pattern of each defect; at most 5 * 3 ** N_VOTES rows."""
    spark = patterns.sparkSession
    parts = [F.struct(F.lit(d).alias("defect"), F.substring("pattern", i * N_VOTES + 1, N_VOTES).alias("part")) for i, d in enumerate(DEFECTS)]
    whole = patterns.groupBy("pattern").count()
    counts = whole.select(F.explode(F.array(*parts)).alias("p"), "count").groupBy("p.defect", "p.part").agg(F.sum("count").alias("n"))
    by: dict[str, dict[tuple[int, ...], int]] = {d: {} for d in DEFECTS}
    for r in counts.collect():  # bounded by the number of patterns
        by[r.defect][tuple(-1 if c == "2" else int(c) for c in r.part)] = r.n
    rows = [(d, "".join("2" if v < 0 else str(v) for v in k), p) for d, c in by.items() for k, p in fit_label_model(c).items()]
    return spark.createDataFrame(rows, "defect string, part string, posterior double")


def defective_pairs(query_results: DataFrame, questions: DataFrame, cutoffs: dict[str, float] = CUTOFFS) -> DataFrame:
    """(record_set, row_id, defect, posterior): every defect of each pair whose posterior exceeds its cutoff, once.

    A null answer is empty. A null question cannot be copied or differ in language from anything but English.
    Repeated rows of one id come once (with the highest posterior); an empty table gives no row.
    """
    from siltra.llm.common import materialize

    patterns = materialize(vote_patterns(pairs_of(query_results, questions)), "votes")
    post = posteriors(patterns)
    cut = F.element_at(F.create_map(*[F.lit(x) for kv in cutoffs.items() for x in kv]), F.col("defect"))
    flagged = F.broadcast(post.where(F.col("posterior") > cut))
    parts = [F.struct(F.lit(d).alias("defect"), F.substring("pattern", i * N_VOTES + 1, N_VOTES).alias("part")) for i, d in enumerate(DEFECTS)]
    voted = patterns.where(F.col("pattern").contains("1")).select("record_set", "row_id", F.explode(F.array(*parts)).alias("p")).select("record_set", "row_id", "p.*")
    return voted.join(flagged, ["defect", "part"]).groupBy("record_set", "row_id", "defect").agg(F.max("posterior").alias("posterior"))
