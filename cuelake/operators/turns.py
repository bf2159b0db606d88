"""Who speaks each cue.

What a text shows by itself (a greeting, a question, the person of its verbs) is a column. Evidence for a change of speaker is a table
of rules over a cue and the one before it, met by one lag; each rule is a family, a name, a condition and a weight, and a score
is summed from sorted arrays, so all of it is generated code. Only the last step, which speaker takes a turn, rests on the turns before: a fold
over (pull, voice) with a state of a few numbers, in order, batch by batch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions.script import cyr2lat, normalize, romanized

from .ordered import fold

#: What a boundary's evidence weighs, and the thresholds it is held against.
NEW, KEEP, ALTERNATE, STRONG = 0.85, -1.60, 0.55, 1.30
OVERLAP, LONG_GAP, CONTINUES = 0.90, 0.45, -2.20
REPLY, BACKCHANNEL, FLOOR, ROLE_FLIP, ADDRESS, PERSON = 0.90, 0.85, 0.55, 0.55, 0.45, 0.70
VOICE_FAR, VOICE_NEAR, FAR_FROM, NEAR_TO = 1.00, -0.35, 0.45, 0.18
SECOND, GAP_SAME, GAP_LONG, MEMORY, MOST_SPEAKERS = 0.30, 0.35, 2.5, 12, 8
#: Endings and words that mark a person, and words by role.
SECOND_ENDS, FIRST_ENDS = ("siz", "san", "sang", "ding", "ngiz"), ("man", "miz", "dim", "dik", "sam")
NOT_VERBS = "roman dushman german oman qasam insan somon".split()
SECOND_WORDS, FIRST_WORDS = "siz sen size senga seni sizni".split(), "men biz menga mening bizning mendan".split()
SECOND_RU, FIRST_RU = "вы ты вас вам тебя тобой".split(), "я мы меня мне наш мой моя".split()
FLOOR_TAKERS = (
    "assalomu", "salom", "hayrli", "rahmat", "rahmat sizga", "kiring", "keling", "to'xtang", "toxtang", "ayting", "aytib bering", "tushuntiraman", "javob", "savol",
    "menimcha", "menda", "bu yerdaman", "xullas", "yo'q," "yoq,", "ha,", "ha, albatta", "tushundim", "qanday yordam", "eslatib o'taman",
)
ANSWERS = (
    "ha", "aha", "oh", "ooh", "uvvoh", "aan", "anj anch", "tushundim", "tushunarli", "yaxmi", "mayli", "joyida", "to'g'ri", "tougri", "ro'stmi", "rostmi", "ha ha",
    "rahmat", "jaxshimi", "qaerda", "keldim", "eshityapman",
)
ADDRESSES = "aka opa ustoz ustozim do'stim dostim azizim janob hurmatli jonim farzandim rahbar".split()
GREETINGS = ("assalomu", "salom", "hello", "dobriy", "privet", "assalom")
GREETING_REPLIES = ("va alaykum", "valaykum", "w alaykum", "alaykum assalom", "va alaikum")


def _both_ways(words: list[str]) -> list[str]:
    """Words as a romanized text can hold them, ы as itself or as y."""
    low = [cyr2lat(normalize(w)).lower() for w in words]
    return sorted({*low, *(w.replace("ы", "y") for w in low)})


SECOND_ALL, FIRST_ALL = SECOND_WORDS + _both_ways(SECOND_RU), FIRST_WORDS + _both_ways(FIRST_RU)

#: Patterns that the checking SQL shares: space, a word, and what a text shows.
_S = r"[\s\p{Z}]"
WORD = r"\p{L}+(?:'\p{L}+)*"
NOT_WORD = r"[^\p{L}\p{N}_']+"
BLANK = rf"\A{_S}*\z"
ENDED = rf"[.!?…]{_S}*\z"
RUNS_ON = rf"\A{_S}*[\p{{Ll}}—,\-…]"
ASKS = rf"(\?|mi{_S}*[?.!]?){_S}*\z"
NAMED = r"[,;]\s*[A-ZА-Я]([\p{L}\p{N}_'`]{0,23}[\p{L}\p{N}_]([^\p{L}\p{N}_]|\z)|[\p{L}\p{N}_'`]{0,23}['`][\p{L}\p{N}_])"


def opening(words: tuple[str, ...]) -> str:
    return rf"\A{_S}*({'|'.join(words)})"


ANSWER = rf"\A({'|'.join(ANSWERS)})( |\z)"


def folded(text: Column) -> Column:
    """Latin letters in lower case, one apostrophe."""
    return F.lower(romanized(F.coalesce(text, F.lit(""))))


def person(words: Column) -> Column:
    """1 or 2 by the ending of the last word that has one, else by pronouns of one kind only; 0 if neither."""
    stem = lambda w: F.when(F.endswith(w, F.lit("mi")) & (F.length(w) > 4), F.substring(w, F.lit(1), F.length(w) - 2)).otherwise(w)
    ends = lambda w, kinds: F.exists(F.array(*map(F.lit, kinds)), lambda e: F.endswith(stem(w), e))
    marks = F.transform(words, lambda w: F.when(w.isin(NOT_VERBS), 0).when(ends(w, SECOND_ENDS), 2).when(ends(w, FIRST_ENDS), 1).otherwise(0))
    has = lambda kinds: F.arrays_overlap(words, F.array(*map(F.lit, kinds)))
    said = F.filter(marks, lambda m: m > 0)
    second, first = has(SECOND_ALL), has(FIRST_ALL)
    return F.when(F.size(said) > 0, F.element_at(said, -1)).when(second & ~first, 2).when(first & ~second, 1).otherwise(0)


SIGNS = ("blank", "ended", "runs_on", "greets", "greets_back", "answers", "takes_floor", "asks", "addresses", "person")


def signs(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with a column for each of SIGNS: what a text shows by itself. Null counts as empty."""
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = rows.withColumn("_low", folded(F.col(text))).withColumns({"_words": F.regexp_extract_all("_low", F.lit(WORD), F.lit(0)), "_bare": F.trim(F.regexp_replace("_low", NOT_WORD, " "))})
    low, words, bare = F.col("_low"), F.col("_words"), F.col("_bare")
    shown = {
        "blank": raw.rlike(BLANK),
        "ended": raw.rlike(ENDED),
        "runs_on": raw.rlike(RUNS_ON),
        "greets": low.rlike(opening(GREETINGS)),
        "greets_back": low.rlike(opening(GREETING_REPLIES)),
        "answers": bare.rlike(ANSWER) & (F.regexp_count(bare, F.lit(WORD)) <= 3),
        "takes_floor": low.rlike(opening(FLOOR_TAKERS)),
        "asks": low.rlike(ASKS),
        "addresses": F.arrays_overlap(words, F.array(*map(F.lit, ADDRESSES))) | raw.rlike(NAMED),
        "person": person(words),
    }
    return rows.withColumns(shown).drop("_low", "_words", "_bare")


@dataclass(frozen=True)
class Rule:
    """When a boundary has this evidence: conditions over the cue before (p), the cue (c), the gap and the cue's length."""

    family: int
    name: Callable[..., Column]
    when: Callable[..., Column]
    weight: float


def _plain(name: str) -> Callable[..., Column]:
    return lambda p, c, gap, length: F.lit(name)


RULES = (
    Rule(0, lambda p, c, gap, length: F.format_string("overlap:%.2fs", -gap), lambda p, c, gap, length: (gap < -0.05) & (-gap < F.greatest(length, F.lit(0.0))), OVERLAP),
    Rule(0, lambda p, c, gap, length: F.format_string("gap:%.1fs", gap), lambda p, c, gap, length: gap >= GAP_LONG, LONG_GAP),
    Rule(0, _plain("continuation"), lambda p, c, gap, length: c["blank"] | (gap <= GAP_SAME) & ~p["ended"] & c["runs_on"], CONTINUES),
    Rule(1, _plain("reply-greeting"), lambda p, c, gap, length: p["greets"] & c["greets_back"], REPLY),
    Rule(1, _plain("backchannel"), lambda p, c, gap, length: c["answers"] & ~p["answers"], BACKCHANNEL),
    Rule(1, _plain("floor-taker"), lambda p, c, gap, length: c["takes_floor"] & ~p["takes_floor"], FLOOR),
    Rule(1, _plain("adjacency:role-flip"), lambda p, c, gap, length: p["asks"] != c["asks"], ROLE_FLIP),
    Rule(1, _plain("vocative"), lambda p, c, gap, length: c["addresses"] & ~p["addresses"], ADDRESS),
    Rule(2, lambda p, c, gap, length: F.format_string("person:%d>%d", p["person"], c["person"]), lambda p, c, gap, length: (p["person"] > 0) & (c["person"] > 0) & (p["person"] != c["person"]), PERSON),
)


def scored(rows: DataFrame, key: str, order: str, start: str, end: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """rows (with SIGNS) with score and cues: the evidence of each boundary; a key's first cue has none.

    Of a family the strongest counts whole, the next at SECOND, others are named only.
    """
    w = Window.partitionBy(key).orderBy(order)
    rows = rows.withColumn("_c", F.struct(*SIGNS, F.col(start).alias("s"), F.col(end).alias("e"))).withColumn("_p", F.lag("_c").over(w))
    c, p = F.col("_c"), F.col("_p")
    given = (p, c, c["s"] - p["e"], c["e"] - c["s"])
    total, names = F.lit(0.0), []
    for family in sorted({r.family for r in rules}):
        found = [F.when(r.when(*given), F.struct(F.lit(-abs(r.weight)).alias("by"), F.lit(k).alias("k"), r.name(*given).alias("name"), F.lit(r.weight).alias("weight"))) for k, r in enumerate(rules) if r.family == family]
        ranked = F.sort_array(F.filter(F.array(*found), lambda x: x.isNotNull()))
        worth = lambda k, a=ranked: F.coalesce(F.get(a, F.lit(k))["weight"], F.lit(0.0))
        total = total + (worth(0) + worth(1) * SECOND)
        names.append(F.transform(ranked, lambda x: x["name"]))
    first = p.isNull()
    score = F.when(first, 0.0).otherwise(total)
    return rows.withColumns({"score": score, "cues": F.when(first, F.array().cast("array<string>")).otherwise(F.concat(*names))}).drop("_c", "_p")


def apart(a: list[float] | None, b: list[float] | None) -> float | None:
    """Relative L1 distance of two voices."""
    if a is None or b is None:
        return None
    parts = [abs(x - y) / max(abs(x), abs(y), 1e-9) for x, y in zip(a, b, strict=False)]
    return sum(parts) / len(parts)


@dataclass
class Room:
    """The turns so far: who speaks, who spoke before and for how many cues since; sums of each speaker's voices, and the last voice."""

    most: int
    now: int = 0
    before: int = 0
    run: int = 0
    known: int = 1
    heard: dict[int, tuple[list[float], int]] = field(default_factory=dict)
    last: list[float] | None = None

    def closest(self, voice: list[float] | None) -> tuple[float | None, int]:
        """(distance, speaker) of the known voice that is nearest; of equal ones the one heard first."""
        far = [(d, who) for who, (sums, n) in self.heard.items() if (d := apart([round(s / n, 4) for s in sums], voice)) is not None] if voice is not None else []
        return min(far, key=lambda x: x[0], default=(None, 0))

    def takes(self, pull: float, voice: list[float] | None) -> tuple[int, float | None]:
        """(who speaks, distance of voices that counts as evidence) of the next cue, whose evidence but for voices pulls so much."""
        if not self.now:
            return 1, None
        near, owner = self.closest(voice)
        step = apart(self.last, voice)
        ear = None if step is None else step if near is None else near
        score = pull + ear_weight(ear)
        other = self.before if self.run < MEMORY else 0
        fresh = self.known + 1 if self.known < self.most else 0
        stranger = near is not None and near >= FAR_FROM or step is not None and step >= FAR_FROM
        if score <= KEEP:
            return self.now, ear
        if score >= NEW or stranger:
            if voice is not None:
                choice = (owner if near is not None and near < FAR_FROM else 0, fresh, other)
            else:
                choice = (other, fresh) if score < STRONG else (fresh, other)
            return next((who for who in choice if who), self.now), ear
        familiar = near is not None and near <= NEAR_TO
        return (other or self.now) if score >= ALTERNATE and self.known > 1 and not familiar else self.now, ear

    def turn(self, who: int, voice: list[float] | None) -> None:
        if who != self.now:
            self.before, self.now, self.run = self.now, who, 0
        self.run += 1
        self.known = max(self.known, who)
        if voice is not None:
            sums, n = self.heard.get(who, ([0.0] * len(voice), 0))
            self.heard[who] = ([a + b for a, b in zip(sums, voice, strict=True)], n + 1)
        self.last = voice


def ear_weight(ear: float | None) -> float:
    return 0.0 if ear is None else VOICE_FAR if ear >= FAR_FROM else VOICE_NEAR if ear <= NEAR_TO else 0.0


def _spoken(room: Room, row: dict) -> tuple:
    """speaker, score, cues, confidence of a row with score, cues and voice."""
    voice = row.get("voice")
    first, now = not room.now, room.now
    who, ear = room.takes(row["score"], voice)
    score = row["score"] + ear_weight(ear)
    names = row["cues"] + ([f"{'voice' if ear >= FAR_FROM else 'same-voice'}:{ear:.2f}"] if ear_weight(ear) else [])
    room.turn(who, voice)
    held = 0.0 if first else round(max(0.0, min(1.0, 0.5 + abs(score - (NEW if who != now else 0.0)) / 2.5)), 2)
    return who, round(score, 3), names, held


def speakers(cues: DataFrame, key: str = "doc", order: str = "idx", start: str = "start_s", end: str = "end_s", text: str = "text", voice: str | None = None, most: int = MOST_SPEAKERS) -> DataFrame:
    """key, order, speaker, score, cues, confidence. ``voice`` names a column of three measures, if there is one; a null, or a voice that lacks a measure, is none."""
    heard = [F.when(~F.exists(voice, lambda m: m.isNull()), F.col(voice)).alias("voice")] if voice else []
    rows = signs(cues.select(key, order, start, end, text, *heard), text)
    rows = scored(rows, key, order, start, end).select(key, order, "score", "cues", *["voice"] * bool(voice))
    most = max(1, most)
    told = fold(rows.withColumnsRenamed({"score": "pull", "cues": "told"}), [key], [order], lambda: Room(most), lambda room, row: _spoken(room, row | {"score": row["pull"], "cues": row["told"]}), "speaker int, score double, cues array<string>, confidence double")
    return told.select(key, order, "speaker", "score", "cues", "confidence")
