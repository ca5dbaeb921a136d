"""Problem 1: defective prompt and response pairs."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stage
from .endings import Terminality, closing_counts, emptied, opened, shortened_number
from .words import Words, mix, split

DEFECTS = ("empty", "truncated", "refusal", "copied", "other_language")

# Function words (articles, pronouns, prepositions, conjunctions, auxiliaries) of four languages.
FUNCTION_WORDS = {
    "en": "the of and to is are was were that this these those with from for by it its be been not have has had which will would can could should must may at as or if then when what who how they them their we us our you your he she his her i my there so all out into after before because each every than but about over under while until where such only also both any some more most other between through during since yes same no too very does did do being am",
    "de": "der die das und ist sind war waren von mit auf für den dem des ein eine einen einem einer nicht sich auch nach bei wie aus zu zur zum wir uns sie er es ich ihr ihre ihm als oder wenn dann noch wieder kann können wird werden hat haben hatte also keine kein ja jeder jede jeden jedes weil deshalb über durch um vor aber nur so dass man sehr unter zwischen während bis seit ohne gegen wo wer was warum denn doch schon mehr muss müssen soll bin davon dort dieser diese dieses im am ins",
    "fr": "le la les des du et est sont était que qui dans pour par sur avec pas ne au aux une un il elle ils elles nous vous je on ce cet cette ces mais ou où donc car plus après avant avoir être fait cela rien même chaque aucun aucune ici oui y d l n qu s c j leur leurs son sa ses notre votre si comme quand très sans sous entre pendant depuis jusqu tout tous toute toutes dont lui se en avons avez ont faut peut",
    "es": "el los las de del y e es son era que en para por con no se al una un uno lo su sus como pero más o u ya hay tanto así cada hasta desde antes sí mi tu nos les le este esta estos estas ese esa eso muy sin sobre entre durante cuando donde quien cual si porque también sólo solo todo todos toda todas otro otra ser estar ha han he fue eran está están ni aquí allí a ante bajo tras",
}
MARKS = {"de": "äöß", "fr": "çèêàùîœ", "es": "ñ¿¡óíá"}

# How a refusal is put.
REFUSES = re.compile(
    r"(?i)(?:\b(?:can ?not|can['’]t|won['’]t|will not|unable to|not able to|declines?(?: to)?|refuses? to|rather not|prefer not to|not allowed to|not permitted to|no position to|not for me to|do not|don['’]t|must not|should not)\b[^.!?\n]{0,12}\b(?:help|assist|answer(?:[.!?,;]|$| (?:this|that|these|it|your|what|such|any|anything|questions?|the))|solve|work on|complete|comment|take on|say anything|respond|provide|discuss|engage|fulfil)"
    r"|\b(?:kann|möchte|darf|werde|sollte|will|können|dürfen|muss)\b[^.!?\n]{0,70}\b(?:nicht|ablehnen|nichts)\b[^.!?\n]{0,24}"
    r"|\b(?:préfère|peux|puis|saurais|permis|contraint|dois|souhaite|veux)\b[^.!?\n]{0,12}\bpas\b[^.!?\n]{0,60}|\bje refuse\b"
    r"|\b(?:no (?:puedo|debo|quiero|voy a|me está permitido|me es posible)|prefiero no|negarme a|me niego a|rechazo)\b)"
)
REGRETS = re.compile(
    r"(?i)sorry|apolog|unfortunately|i regret|language model|safety reasons|to be honest|thanks for asking|leider|bedauer|sprachmodell|sicherheitsgründen|tut mir leid|ehrlich gesagt|anliegen|désolé|malheureusement|regret|modèle de langue|raisons de sécurité|honnêtement|lo siento|lamentablemente|con todo respeto|modelo de lenguaje|motivos de seguridad|sinceramente"
)
TURNS_AWAY = re.compile(r"(?i)rephrase|another topic|something else you|hope you understand|hoffe auf verständnis|anderen thema|anderes thema|autre chose|votre compréhension|otra cosa|lo entienda|otro tema")
# Names of the languages that a question may ask for.
ASKED = {
    "en": r"in english|auf englisch|en anglais|en inglés",
    "de": r"in german|auf deutsch|en allemand|en alemán",
    "fr": r"in french|auf französisch|en français|en francés",
    "es": r"in spanish|auf spanisch|en espagnol|en español",
}
LANGS = tuple(FUNCTION_WORDS)
ACTION_LINE = r"(?m)^[ \t>]*(?:\d+[.)]|[-*])?[ \t]*(?:MOVE|COLLECT|DEPOSIT|REST|WAIT|move|collect|deposit|rest|wait)\b[^\n]*$"

# Labelling functions by defect: starting probabilities of a vote for and against it, given the defect and given none.
START = {
    "empty": [(0.99, 0.001, 0.0, 0.99), (0.9, 0.01, 0.02, 0.9), (0.8, 0.02, 0.05, 0.9)],
    "truncated": [(0.7, 0.003, 0.01, 0.1), (0.5, 0.003, 0.01, 0.1), (0.5, 0.002, 0.03, 0.9), (0.3, 0.05, 0.5, 0.85), (0.01, 0.02, 0.01, 0.01)],
    "refusal": [(0.97, 0.0003, 0.02, 0.9), (0.5, 0.02, 0.0, 0.0), (0.3, 0.002, 0.0, 0.0), (0.9, 0.05, 0.01, 0.9)],
    "copied": [(0.95, 0.01, 0.02, 0.95), (0.9, 0.01, 0.03, 0.9), (0.9, 0.05, 0.02, 0.9), (0.7, 0.01, 0.1, 0.3)],
    "other_language": [(0.95, 0.01, 0.01, 0.9), (0.7, 0.02, 0.02, 0.3), (0.7, 0.01, 0.05, 0.8)],
}
#: Votes for a defect that other kinds draw, at the start: (kind, defect, functions): probability. A refusal comes in any language, a copy stops anywhere, and what gives no result has no number of its own.
BESIDE = {
    ("refusal", "other_language", (0, 1, 2)): 0.2, ("copied", "truncated", (0, 1, 2)): 0.3, ("refusal", "truncated", (2,)): 0.1, ("empty", "truncated", (2,)): 0.1,
    ("prose", "refusal", (3,)): 0.8, ("prose", "copied", (2,)): 0.8, ("refusal", "copied", (2,)): 0.8,
}


def pairs(records: DataFrame, candidates: DataFrame) -> DataFrame:
    """tab, row_ord, msg_pos, question, answer, finish: every pair of both tables.

    An assistant message answers the last user message before it, a candidate
    the first user message of its source record (of its earliest delivery). A
    missing question reads as null. Repeated rows are pairs of their own.
    """
    each = F.expr(
        "transform(filter(sequence(0, size(messages) - 1), i -> messages[i].role = 'assistant'), i -> struct(i as msg_pos, "
        "try_element_at(filter(slice(messages, 1, i), m -> m.role = 'user'), -1).content as question, messages[i].content as answer))"
    )
    s = records.where("size(messages) > 0").select("row_ord", F.explode(each).alias("p"))
    s = s.select(F.lit("sft_records").alias("tab"), "row_ord", "p.msg_pos", "p.question", "p.answer", F.lit(None).cast("string").alias("finish"))
    user = F.get(F.filter("messages", lambda m: m["role"] == "user"), F.lit(0))["content"]
    asked = records.where("id is not null").select(F.col("id").alias("source_record_id"), "row_ord", user.alias("question"))
    asked = asked.groupBy("source_record_id").agg(F.min_by("question", "row_ord").alias("question"))
    c = candidates.select("source_record_id", "row_ord", F.col("text").alias("answer"), F.lower("finish_reason").alias("finish")).join(asked, "source_record_id", "left")
    return s.unionByName(c.select(F.lit("candidates").alias("tab"), "row_ord", F.lit(0).alias("msg_pos"), "question", "answer", "finish"))


def _array(mask: pa.Array) -> np.ndarray:
    return mask.to_numpy(zero_copy_only=False).astype(bool)


#: Numbers of the function words, and their weights by language; one that several languages share says less.
FUNCTION_WORD = {x: i for i, x in enumerate(sorted({x for v in FUNCTION_WORDS.values() for x in v.split()}))}
WEIGHTS = np.array([[x in v for v in (set(v.split()) for v in FUNCTION_WORDS.values())] for x in FUNCTION_WORD], float)
WEIGHTS[WEIGHTS.sum(1) > 1] *= 0.3
#: Places of the table in which words of questions are marked at once.
CELLS = 1 << 22


def _matches(texts: pa.Array, pattern: str, where: np.ndarray) -> np.ndarray:
    """Texts that match, among those at ``where``; only these are read."""
    out = np.zeros(len(texts), bool)
    at = np.flatnonzero(where)
    if len(at):
        out[at] = _array(pc.match_substring_regex(texts.take(pa.array(at)), pattern))
    return out


def _replaced(texts: pa.Array, pattern: str, where: np.ndarray) -> pa.Array:
    """Texts with matches as a blank; only those at ``where`` can match."""
    if not where.any():
        return texts
    return pc.replace_with_mask(texts, pa.array(where), pc.replace_substring_regex(texts.filter(pa.array(where)), pattern, " "))


def _of(words: Words, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words of some texts, one text after the other, and where each begins."""
    count = words.counts[texts]
    offsets = np.concatenate([[0], np.cumsum(count)])
    return words.codes[np.repeat(words.offsets[texts] - offsets[:-1], count) + np.arange(offsets[-1])], offsets


def _held(codes: np.ndarray, offsets: np.ndarray, by: np.ndarray, by_offsets: np.ndarray, size: int) -> np.ndarray:
    """Whether each code of a row is among the codes ``by`` of the same row; codes are below ``size``.

    They are marked in a table of about CELLS places, some rows at a time.
    """
    n, step = len(offsets) - 1, max(1, CELLS // max(1, size))
    out = np.zeros(len(codes), bool)
    seen = np.zeros(min(n, step) * size, bool)
    for a in range(0, n, step):
        z = min(n, a + step)
        mine, theirs = slice(offsets[a], offsets[z]), slice(by_offsets[a], by_offsets[z])
        base = np.arange(z - a) * size
        marks = np.repeat(base, np.diff(by_offsets[a : z + 1])) + by[theirs]
        seen[marks] = True
        out[mine] = seen[np.repeat(base, np.diff(offsets[a : z + 1])) + codes[mine]]
        seen[marks] = False
    return out


def _run_share(codes: np.ndarray, offsets: np.ndarray, by: np.ndarray, by_offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The share of each row's runs of five codes that are among those of ``by``, and how many runs it has."""

    def keys(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = np.maximum(np.diff(offsets) - 4, 0)
        owner = np.repeat(np.arange(len(count)), count)
        at = np.repeat(offsets[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        run = np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(5):
                run = run * np.uint64(1_000_003) + codes[at + k].astype(np.uint64)
            return mix(run) + mix(owner.astype(np.uint64), 5), owner

    mine, owner = keys(codes, offsets)
    total = np.bincount(owner, minlength=len(offsets) - 1)
    return np.bincount(owner, weights=np.isin(mine, keys(by, by_offsets)[0]), minlength=len(offsets) - 1) / np.maximum(1, total), total


def _only(words: Words, number: np.ndarray) -> Words:
    """Those words whose code has a number, by their numbers."""
    code = number[words.codes] if len(words.codes) else words.codes
    kept = code >= 0
    return Words(code[kept], np.concatenate([[0], np.cumsum(kept)])[words.offsets], [])


def _weights(codes: np.ndarray, offsets: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
    """Weights of each text's function words by language."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    hit = WEIGHTS[codes] if keep is None else WEIGHTS[codes] * keep[:, None]
    return np.stack([np.bincount(owner, weights=x, minlength=n) for x in hit.T], 1)


def votes(question: pa.Array, answer: pa.Array, finish: pa.Array, scorer: Terminality) -> dict[str, np.ndarray]:
    """Votes of all labelling functions by defect: 1 for it, 2 against it, 0 neither; a row per pair."""
    n = len(answer)
    q = pc.fill_null(question.cast(pa.large_string()), "")
    a = pc.fill_null(answer.cast(pa.large_string()), "")
    empty = emptied(answer)
    size = pc.utf8_length(a).to_numpy(zero_copy_only=False)
    braces = _array(pc.match_substring(a, "{"))
    has_json = braces & _array(pc.match_substring(a, '{"'))
    has_json[has_json] = _array(pc.match_substring(pc.utf8_lower(a.filter(pa.array(has_json))), '"actions"'))
    # Plans are told from prose; what is left is read as language.
    acts = _array(pc.match_substring_regex(a, ACTION_LINE))
    own_text = a
    if braces.any():
        own_text = pc.replace_with_mask(a, pa.array(braces), pa.array([x.partition("{")[0] + " " for x in a.filter(pa.array(braces)).to_pylist()], pa.large_string()))
    own_text = _replaced(own_text, ACTION_LINE, acts)
    has_plan = has_json | acts
    # Texts are read once: a question stands beside several answers, a copy is its question.
    asking = pc.dictionary_encode(q)
    asks = _replaced(asking.dictionary, r"(?s)\{[^\n]*\}", _array(pc.match_substring(asking.dictionary, "{")))
    q_of = asking.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # An answer that holds a structured plan isn't a copy; its words needn't be compared.
    plain = pc.if_else(pa.array(has_json), pa.scalar("", pa.large_string()), a)
    bank = pc.dictionary_encode(pa.concat_arrays([asking.dictionary, asks, plain, own_text]))
    of_q, of_asks, of_a, of_own = np.split(bank.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum([len(asks), len(asks), n]))
    of_q, of_asks = of_q[q_of], of_asks[q_of]
    w = split(bank.dictionary)
    functions = _only(w, np.array([FUNCTION_WORD.get(x, -1) for x in w.vocab], np.int64))
    # Words of the answer that the question has too say nothing about its own language.
    said, said_at = _of(functions, of_own)
    new = ~_held(said, said_at, *_of(functions, of_asks), len(WEIGHTS))
    qc, ac = _weights(functions.codes, functions.offsets)[of_asks], _weights(said, said_at, new)
    q_lang = np.where(qc.max(1) > 0, qc.argmax(1), -1) if n else np.zeros(0, np.int64)
    best = ac.argmax(1) if n else np.zeros(0, np.int64)
    order = np.sort(ac, axis=1) if n else np.zeros((0, 4))
    asks = pc.utf8_lower(asks)
    any_asked = _array(pc.match_substring_regex(asks, "|".join(ASKED.values())))
    asked = np.stack([_matches(asks, ASKED[k], any_asked) for k in LANGS], 1)[q_of]
    expected = asked.copy()
    expected[np.arange(n), np.maximum(q_lang, 0)] |= q_lang >= 0
    known = (q_lang >= 0) | asked.any(1)
    clear = (order[:, -1] >= 2) & (order[:, -1] >= 2 * order[:, -2])
    off = ~expected[np.arange(n), best] & known

    # Copies: words of the whole answer that the question holds, runs of five, new numbers.
    digit = np.array([x[0].isdigit() for x in w.vocab], bool)
    q_words, n_words = w.counts[of_q], w.counts[of_a]
    same = of_q == of_a
    held = np.where(same, n_words, 0) / np.maximum(1, n_words)
    fresh = np.zeros(n, bool)
    total_runs = np.where(same, np.maximum(n_words - 4, 0), 0)
    run_share = (total_runs > 0).astype(float)
    at = np.flatnonzero(~same & (n_words > 0))
    theirs, ours = _of(w, of_q[at]), _of(w, of_a[at])
    inside = _held(*ours, *theirs, len(w.vocab))
    owner = np.repeat(np.arange(len(at)), np.diff(ours[1]))
    held[at] = np.bincount(owner, weights=inside, minlength=len(at)) / np.maximum(1, n_words[at])
    fresh[at] = np.bincount(owner, weights=~inside & digit[ours[0]], minlength=len(at)) > 0
    # Runs say nothing where there is a new number.
    at = at[~fresh[at]]
    run_share[at], total_runs[at] = _run_share(*_of(w, of_a[at]), *_of(w, of_q[at]))
    solved = fresh | has_plan
    # An answer with a plan or a number that its question lacks declines nothing; only the others are read for it.
    refuses, regrets, turns_away = (_matches(a, x.pattern, ~solved) for x in (REFUSES, REGRETS, TURNS_AWAY))
    copy_like = (held >= 0.85) & ~fresh & ~has_json & (n_words >= 4)
    ends_with = copy_like & same  # a copy that ends where the question, a line or a sentence of it does
    stopped = np.zeros(n, bool)
    for k in np.flatnonzero(copy_like & ~same):
        x, y = q[int(k)].as_py().lower(), a[int(k)].as_py().lower()
        qw, aw = re.findall(r"[^\W_]+", x), re.findall(r"[^\W_]+", y)
        tail = aw[-3:]
        m = re.search(r"[\W_]+".join(map(re.escape, tail)) + r"(?P<rest>[^\n]?[\W_]*)", x)
        ends_with[k] = aw[-2:] == qw[-2:] or bool(m and (m.end() == len(x) or re.search(r"[.!?:\n]", m.group("rest"))))
        stopped[k] = not ends_with[k]

    structure = opened(answer) & ~empty
    score, fragment = scorer.score(answer)
    cut_number = np.zeros(n, bool)
    strip = pc.utf8_rtrim_whitespace(a)
    for k in np.flatnonzero(_array(pc.match_substring_regex(pc.utf8_slice_codeunits(strip, -1), r"\d"))):
        cut_number[k] = shortened_number(strip[int(k)].as_py())
    fin = pc.fill_null(finish.cast(pa.large_string()), "")
    ended = _array(pc.is_in(fin, value_set=pa.array(["stop", "eos", "end", "complete"], pa.large_string())))
    limited = _array(pc.is_in(fin, value_set=pa.array(["length", "max_tokens", "abort", "limit"], pa.large_string())))

    def vote(yes: np.ndarray, no: np.ndarray | bool = False) -> np.ndarray:
        return np.where(yes, 1, np.where(no, 2, 0)).astype(np.int64)

    some = ~empty
    accents = np.zeros(n, bool)
    # All marks are other characters than ASCII.
    marked = np.flatnonzero(~_array(pc.string_is_ascii(own_text)))
    lowered = pc.utf8_lower(own_text.take(pa.array(marked)))
    for k, marks in MARKS.items():
        accents[marked] |= _array(pc.match_substring_regex(lowered, f"[{marks}]")) & ~expected[marked, LANGS.index(k)]
    short = size < 24
    wordless = ~_matches(own_text, r"\d", short) & ~_matches(pc.utf8_lower(pc.utf8_slice_codeunits(a, 0, 24)), r"\pL{3,}\PL+\pL{2,}", short)
    ratio = order[:, -1] / np.maximum(1, order.sum(1))
    # Every defect is voted on by what it looks at alone; what defects have to do with each other is the label model's to find.
    out = {
        "empty": [vote(empty, some), vote(short & wordless, ~short), vote((n_words <= 2) & ~has_json, (n_words > 3) | has_json)],
        "truncated": [
            vote(structure),
            vote((fragment | cut_number) & some),
            vote((score < 0.15) & some, (score >= 0.3) & ~structure & ~fragment & ~cut_number | empty),
            vote(limited, ended),
            vote(stopped & some & (fragment | structure)),
        ],
        "refusal": [vote(refuses, ~refuses), vote(regrets), vote(turns_away), vote(~solved & (n_words <= 45) & ~copy_like & some, solved)],
        "copied": [vote(copy_like, (held < 0.8) | has_json), vote((run_share >= 0.6) & (total_runs > 0) & ~fresh, (run_share < 0.5) | fresh | has_json), vote(~fresh & ~has_plan & some & (n_words >= 4), fresh | has_json), vote(ends_with & (n_words >= 0.3 * q_words), fresh | stopped)],
        "other_language": [vote(clear & off & some, (ac.max(1) >= 2) & ~off), vote(accents & some, clear & ~off), vote(off & clear & (ratio >= 0.75) & some, ~off | ~clear)],
    }
    return {k: np.stack(v, 1) for k, v in out.items()}


#: Kinds of pairs: sound ones whose answer gives a result or only says something, and each defect.
KINDS = ("result", "prose", *DEFECTS)
SOUND = 2
#: Shares of the kinds to start from; they are mixed into later ones to a fiftieth, so that no kind dies out.
PRIOR = np.array([0.8, 0.1] + [0.02] * len(DEFECTS))
FUNCTIONS = [(d, j) for d in DEFECTS for j in range(len(START[d]))]


def starting() -> np.ndarray:
    """P(vote | kind) to start from: KINDS, functions of all defects in order, votes neither, for, against."""
    theta = np.empty((len(KINDS), len(FUNCTIONS), 3))
    for f, (d, j) in enumerate(FUNCTIONS):
        p1, p0, n1, n0 = START[d][j]
        for k, kind in enumerate(KINDS):
            p, n = (p1, n1) if kind == d else (p0, n0)
            for (other, of, at), drawn in BESIDE.items():
                if (other, of) == (kind, d) and j in at:
                    p, n = drawn, min(n, 0.97 - drawn)
            theta[k, f] = 1 - p - n, p, n
    theta = np.clip(theta, 1e-4, None)
    return theta / theta.sum(2, keepdims=True)


def posteriors(votes: np.ndarray, theta: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """P(kind | votes) of each row: functions vote independently of each other given the kind."""
    like = np.log(prior)[None, :] + np.log(theta)[:, np.arange(votes.shape[1]), votes].sum(2).T
    like -= like.max(1, keepdims=True)
    p = np.exp(like)
    return p / p.sum(1, keepdims=True)


def sufficient(votes: np.ndarray, weight: np.ndarray, theta: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Expected votes by kind, function and vote, and by kind alone in the last place: what one step needs of some rows."""
    r = posteriors(votes, theta, prior) * weight[:, None]
    out = np.zeros((*theta.shape[:2], 4))
    for v in range(3):
        out[:, :, v] = r.T @ (votes == v)
    out[:, :, 3] = r.sum(0)[:, None]
    return out


def stepped(sums: np.ndarray, base: np.ndarray, strength: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """The maximization step; probabilities are held to ``base`` as by further rows of each kind, ``strength`` of all rows."""
    n = sums[:, 0, 3]
    theta = sums[:, :, :3] + strength * n.sum() * base
    prior = n / max(1e-9, n.sum()) + 0.02 * PRIOR
    return theta / theta.sum(2, keepdims=True), prior / prior.sum()


def fit(total: Callable[[np.ndarray, np.ndarray], np.ndarray], rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximization of the label model: P(vote | kind) and P(kind).

    total: ``sufficient`` over all rows, wherever they are.
    """
    base = starting()
    theta, prior = base, PRIOR.copy()
    for _ in range(rounds):
        sums = total(theta, prior)
        if not sums[:, 0, 3].sum():
            break
        new, share = stepped(sums, base)
        moved = max(np.abs(new - theta).max(), np.abs(share - prior).max())
        theta, prior = new, share
        if moved < 1e-3:
            break
    return theta, prior


def cutoff(post: np.ndarray, weight: np.ndarray, known: np.ndarray, middle: float = 0.5) -> float:
    """The posterior from which on flagging gives the best F1 over validation rows, of which ``known`` tells the share that has the defect.

    Of those within half a hundredth of the best, the one nearest to ``middle``,
    which it is where no row has the defect.
    """
    tried, lower = [], -1.0
    for c in np.unique(post):
        flagged = post >= c
        tp = (known * weight)[flagged].sum()
        # Any cutoff above the next lower posterior flags the same rows.
        at = middle if lower < middle <= c else float(c) if middle > c else (lower + float(c)) / 2
        tried.append((2 * tp / max(1e-9, weight[flagged].sum() + (known * weight).sum()), at))
        lower = float(c)
    if not tried or not (known * weight).sum():
        return middle
    best = max(f for f, _ in tried)
    return min((abs(at - middle), at) for f, at in tried if f >= best - 5e-3)[1]


def planted(sound: DataFrame) -> DataFrame:
    """Sound pairs with defects put in: question, answer, finish, the ``defect`` that is known by construction, and ``n``, how often.

    The answer is emptied, cut off after three fifths, replaced by the question,
    or replaced by the answer to another question in another language. Refusals
    can't be made of sound pairs. An emptied answer draws the same votes
    whatever its question, so those are counted by ``finish`` at once.
    """
    n = F.length("answer")
    kinds = {"truncated": F.when(n > 60, F.substr("answer", F.lit(1), (n * 0.6).cast("int"))), "copied": F.col("question"), "other_language": F.col("other")}
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("defect"), c.alias("answer")) for k, c in kinds.items()))).alias("p")
    each = sound.select("question", "finish", rows).select("question", "p.answer", "finish", "p.defect", F.lit(1).cast("long").alias("n")).where("answer is not null")
    emptied_ones = sound.groupBy("finish").agg(F.count("*").alias("n")).select(F.lit("").alias("question"), F.lit(" ").alias("answer"), "finish", F.lit("empty").alias("defect"), "n")
    return each.unionByName(emptied_ones)


def defective_pairs(records: DataFrame, candidates: DataFrame) -> DataFrame:
    """tab, row_ord, msg_pos, defect: pairs whose posterior of a defect exceeds its cutoff.

    Labelling functions vote on every pair, on each defect by itself. One label
    model over all of them, with two kinds of sound pairs and one of each
    defect, is fitted by expectation-maximization to the patterns of votes of all pairs;
    every round adds up expected votes where the patterns are. Cutoffs are
    chosen on all pairs, whose posteriors stand for their own kind, and on
    defects planted in all sound pairs, which the model has not seen and whose
    kind is known. A pair keeps every label whose posterior exceeds its cutoff.

    A null answer is ``empty``; a null question can't be copied, and any
    language answers it; no pairs give no rows; repeated rows are pairs of
    their own.
    """
    spark = records.sparkSession
    all_pairs = pairs(records, candidates)
    texts = records.select(F.explode(F.expr("filter(messages, m -> m.role = 'assistant')")).alias("m")).select(F.col("m.content").alias("text"))
    counts = closing_counts(texts.unionByName(candidates.select("text")).where("text is not null"))
    sent = spark.sparkContext.broadcast(counts)
    codes = ", ".join(f"{d} short" for d in DEFECTS)

    def scan(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        # The last three columns are question, answer and finish; the first k are handed on.
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = Terminality(sent.value)
            for b in batches:
                if not b.num_rows:
                    continue
                v = votes(*b.columns[-3:], scorer)
                packed = [pa.array((v[d] * 3 ** np.arange(v[d].shape[1])).sum(1).astype(np.int16)) for d in DEFECTS]
                yield pa.RecordBatch.from_arrays([*b.columns[:k], *packed], [*b.schema.names[:k], *DEFECTS])

        return run

    key = ["tab", "row_ord", "msg_pos"]
    # The texts stay beside their votes, since sound ones are needed again.
    voted = stage(all_pairs.select(*key, "question", "answer", "finish").mapInArrow(scan(6), f"tab string, row_ord long, msg_pos int, question string, answer string, finish string, {codes}"), "votes")
    patterns = stage(voted.groupBy(*DEFECTS).agg(F.count("*").alias("n")), "patterns")

    def unpacked(columns: list[pa.Array]) -> np.ndarray:
        return np.stack([columns[DEFECTS.index(d)].to_numpy() // 3**j % 3 for d, j in FUNCTIONS], 1).astype(np.int64)

    def total(theta: np.ndarray, prior: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((*theta.shape[:2], 4))
            for b in batches:
                sums += sufficient(unpacked(b.columns[: len(DEFECTS)]), b.column(len(DEFECTS)).to_numpy().astype(float), theta, prior)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], ["at", "x"])

        got = patterns.select(*DEFECTS, "n").mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
        out = np.zeros((*theta.shape[:2], 4))
        out.ravel()[got.column(0).to_numpy()] = got.column(1).to_numpy()
        return out

    model = fit(total)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = posteriors(unpacked(b.columns[: len(DEFECTS)]), *model)
            p = np.concatenate([p[:, :SOUND].sum(1, keepdims=True), p[:, SOUND:]], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x) for x in p.T)], [*b.schema.names, "p_sound", *(f"p_{d}" for d in DEFECTS)])

    by = ", ".join(f"{p} double" for p in ("p_sound", *(f"p_{d}" for d in DEFECTS)))
    judged = stage(patterns.select(*DEFECTS, "n").mapInArrow(judge, f"{codes}, n long, {by}"), "judged")
    least = _validated(voted, judged, scan, judge, codes, by)
    labels = F.filter(F.array(*(F.when(F.col(f"p_{d}") >= least[d], F.lit(d)) for d in DEFECTS)), lambda x: x.isNotNull())
    flagged = judged.select(*DEFECTS, labels.alias("labels")).where(F.size("labels") > 0).distinct()
    return voted.select(*key, *DEFECTS).join(flagged, list(DEFECTS)).select(*key, F.explode("labels").alias("defect"))


#: Grades of a posterior that validation tells apart, the lowest cutoff, however few rows speak for another one, and sound pairs about which another answer is looked for among each other.
GRADES, LOWEST, AROUND = 1_000, 0.3, 2_000


def beside_others(sound: DataFrame, n: int) -> DataFrame:
    """Adds ``other``: the answer to some question in another language, null where those tried are in the same.

    Pairs are laid out by hash in groups of about AROUND of the n, so that no task holds all of them.
    """
    key = ["tab", "row_ord", "msg_pos"]
    few = {"de": "der|die|und|ist", "fr": "les|des|est|dans", "es": "el|los|que|por"}
    has = lambda x: F.col("low").rlike(rf"\b(?:{x})\b")
    # Most questions have none of these words, which one look tells.
    lang = F.when(~has("|".join(few.values())), "en")
    for k, x in few.items():
        lang = lang.when(has(x), k)
    d = sound.withColumn("low", F.lower("question")).select(*key, "question", "answer", "finish", lang.alias("lang"), F.xxhash64(*key).alias("h")).withColumn("group", F.pmod("h", F.lit(-(-n // AROUND) or 1)))
    w = Window.partitionBy("group").orderBy("h", *key)
    tried = [F.when(at("lang", k).over(w) != F.col("lang"), at("answer", k).over(w)) for k in (7, 3, 1) for at in (F.lead, F.lag)]
    return d.withColumn("other", F.coalesce(*tried)).select("question", "answer", "finish", "other")


def _validated(voted: DataFrame, judged: DataFrame, scan: Callable, judge: Callable, codes: str, by: str) -> dict[str, float]:
    """Cutoff by defect from all pairs and from defects planted in all sound ones.

    Planted defects weigh as much as the cases that the model expects of their kind among the pairs, one at least.
    """
    sure = judged.where("p_sound > 0.99")
    n = sure.agg(F.sum("n")).first()[0] or 0
    sound = voted.join(sure.select(*DEFECTS), list(DEFECTS), "left_semi").where("question is not null and answer is not null")
    shown = planted(stage(beside_others(sound, n), "sound")).select("defect", "n", "question", "answer", "finish").mapInArrow(scan(2), f"defect string, n long, {codes}")
    shown = shown.groupBy("defect", *DEFECTS).agg(F.sum("n").alias("n")).select(*DEFECTS, "n", "defect").mapInArrow(judge, f"{codes}, n long, defect string, {by}")

    def graded(rows: DataFrame) -> DataFrame:
        each = F.explode(F.array(*(F.struct(F.lit(d).alias("of"), F.col(f"p_{d}").alias("p")) for d in DEFECTS))).alias("g")
        return rows.select("defect", "n", each).groupBy("defect", "g.of", F.round(F.col("g.p") * GRADES).cast("int").alias("grade")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("g.p")).alias("has"))

    # At most a row a defect, grade and planted defect reaches the driver.
    rows = graded(judged.withColumn("defect", F.lit(None).cast("string"))).unionByName(graded(shown)).collect()
    expected = {d: max(1.0, sum(r["has"] for r in rows if r["defect"] is None and r["of"] == d)) for d in DEFECTS}
    number = {d: sum(r["n"] for r in rows if r["defect"] == r["of"] == d) for d in DEFECTS}
    out = {}
    for d in DEFECTS:
        of = [r for r in rows if r["of"] == d]
        weight = np.array([r["n"] * (1.0 if r["defect"] is None else expected[r["defect"]] / number[r["defect"]]) for r in of])
        known = np.array([r["has"] / r["n"] if r["defect"] is None else float(r["defect"] == d) for r in of])
        grade = np.array([r["grade"] for r in of], float)
        out[d] = max((cutoff(grade, weight, known, GRADES / 2) - 0.5) / GRADES, LOWEST)
    return out
