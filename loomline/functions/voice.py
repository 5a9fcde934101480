"""Seeds, hashes and categories of voices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import name_key

# Labels that tell voices apart, in their order.
DIFFERENTIATORS = ("brighter timbre", "darker timbre", "slightly quicker cadence", "slower deliberate cadence", "lighter resonance", "deeper chest resonance", "more breathiness", "cleaner crisp articulation")
# What a description must hold, in the order of the tests, and the accent it means.
ACCENTS = ((("yorkshire",), "Yorkshire"), (("french",), "French"), (("german", "scottish"), "German-Scottish"), (("german",), "German"), (("scottish",), "Scottish"), (("irish",), "Irish"), (("welsh",), "Welsh"), (("upperclass",), "Received Pronunciation"), (("aristocratic",), "Received Pronunciation"), (("receivedpronunciation",), "Received Pronunciation"), (("english",), "British"), (("british",), "British"), (("unitedkingdom",), "British"))


def seed(book: Column, role: Column) -> Column:
    """The first 32 bits of the SHA-256 of book:role."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", book, role), 256), 1, 8), 16, 10).cast("long")


def labels(seed: Column, count: int = 3) -> Column:
    """count labels in cyclic order from the seed."""
    every = F.array(*map(F.lit, DIFFERENTIATORS))
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.element_at(every, ((seed + i) % len(DIFFERENTIATORS) + 1).cast("int")))


def with_labels(instruction: Column, labels: Column) -> Column:
    return F.concat(F.rtrim(F.regexp_replace(instruction, r"[. ]+$", "")), F.lit(", with "), F.array_join(labels, ", "), F.lit("."))


def profile_hash(description: Column, instruction: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(description, F.lit("")), F.lit("\n"), F.coalesce(instruction, F.lit(""))), 256)


def accent(identity: Column) -> Column:
    key, out = name_key(identity), None
    for parts, name in ACCENTS:
        holds = F.contains(key, F.lit(parts[0]))
        for p in parts[1:]:
            holds = holds & F.contains(key, F.lit(p))
        out = F.when(holds, name) if out is None else out.when(holds, name)
    return out


def clamp(c: Column, low, high, default) -> Column:
    """A number kept within bounds; the default if it is none."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(c, F.lit(default))))


def choice(c: Column, options: tuple[str, ...], default: str) -> Column:
    x = F.lower(F.trim(c))
    return F.when(x.isin(*options), x).otherwise(default)


# What a narrator's voice is by default, as description and instruction.
NARRATORS = {
    "male": ("adult male audiobook narrator, calm baritone timbre, clear pacing", "A steady adult male audiobook narrator voice with calm baritone timbre, clear audiobook narration, measured pacing, and crisp articulation."),
    "female": ("adult female audiobook narrator, warm alto timbre, clear pacing", "A steady adult female audiobook narrator voice with warm alto timbre, clear audiobook narration, measured pacing, and crisp articulation."),
}
# The instruction for an accent that has none of its own, around the accent's name; what every voice's instruction ends with.
OTHER_ACCENT = " pronunciation: keep the accent consistent, audible, and do not drift into General American unless requested"
# The instructions of accents by their normalised names.
ACCENT_INSTRUCTIONS = {
    "british": "British English pronunciation: non-rhotic R, British vowel shapes, crisp consonants, and no General American rhotic R or American vowel coloring",
    "upperclassbritish": "upper-class southern British Received Pronunciation: non-rhotic R, clipped precise consonants, long bath vowel, controlled intonation, and no General American pronunciation",
    "receivedpronunciation": "upper-class southern British Received Pronunciation: non-rhotic R, clipped precise consonants, long bath vowel, controlled intonation, and no General American pronunciation",
    "yorkshire": "Yorkshire / Northern English accent: northern English vowel shapes, flatter short A sounds, plain regional rhythm, and no General American pronunciation",
    "french": "French-accented English: French vowel coloring, softened th consonants, lightly rolled or softened R, syllable-timed rhythm, and clear understandable English",
    "german": "German-accented English: precise consonants, German vowel coloring, firmer R articulation, and clear understandable English",
    "germanscottish": "German-Scottish accented English: a German consonant edge blended with Scottish rhythm and R color, while staying clear and understandable",
    "welsh": "Welsh-accented English: musical Welsh intonation, clear vowels, lightly rolled R, and no General American pronunciation",
    "irish": "Irish-accented English: Irish rhythm and vowel color, lightly rhotic R, and no General American pronunciation",
    "scottish": "Scottish-accented English: Scottish vowel color, firmer or rolled R, clipped rhythm, and no General American pronunciation",
    "australian": "Australian English pronunciation: Australian vowel shifts, relaxed cadence, and no General American pronunciation",
    "canadian": "Canadian English pronunciation: Canadian vowel color and clear North American cadence, without drifting into exaggerated US regional accents",
    "newyork": "New York English pronunciation: New York vowel color and urban rhythm, without drifting into southern or generic accents",
    "tokyo": "Tokyo Japanese-accented English: Japanese vowel timing, careful consonants, and clear understandable English",
    "generalamerican": "General American pronunciation: rhotic R, neutral US vowel shapes, and no British or regional accent drift",
    "southernamerican": "Southern American pronunciation: southern US vowel color, relaxed drawl, rhotic R, and no British accent drift",
}
DELIVERY = "clear natural audiobook delivery"


def accent_instruction(accent: Column, own: dict[str, str] | None = None) -> Column:
    """The instruction of an accent by its normalised name, or one made of its name; blank for no accent. own: instructions by name besides the fixed ones, or in place of them."""
    t = F.btrim(F.coalesce(accent, F.lit("")))
    table = F.create_map(*[F.lit(x) for kv in (ACCENT_INSTRUCTIONS | (own or {})).items() for x in kv])
    return F.when(t == "", "").otherwise(F.coalesce(F.try_element_at(table, name_key(t)), F.concat(t, F.lit(OTHER_ACCENT))))


def narrator_voice(kind: Column) -> tuple[Column, Column]:
    """Description and instruction of a narrator of a kind; anything but female is male."""
    female = F.coalesce(F.lower(F.btrim(kind)) == "female", F.lit(False))
    return tuple(F.when(female, b).otherwise(a) for a, b in zip(NARRATORS["male"], NARRATORS["female"]))


def profile(name: Column, stage: Column, gender: Column, personality: Column, race: Column, given_accent: Column, own: dict[str, str] | None = None) -> tuple[Column, Column]:
    """A voice's description and instruction from who speaks; personality is an array of traits."""
    known = lambda c: F.when(~F.coalesce(c, F.lit("unknown")).isin("unknown", ""), c)
    blank = lambda c: F.nullif(F.btrim(F.coalesce(c, F.lit(""))), F.lit(""))
    who = F.concat_ws(" ", F.replace(known(stage), F.lit("_"), F.lit(" ")), known(gender))
    who = F.when(who == "", F.concat(name, F.lit(" voice"))).otherwise(who)
    traits = F.array_join(F.filter(F.transform(F.coalesce(personality, F.array().cast("array<string>")), lambda x: F.btrim(x)), lambda x: x != ""), ", ")
    traits = F.when(traits == "", "natural").otherwise(traits)
    said = F.coalesce(blank(given_accent), accent(F.coalesce(race, F.lit(""))))
    description = F.concat_ws("; ", who, traits, blank(race), F.concat(said, F.lit(" accent")))
    spoken = F.nullif(accent_instruction(said, own), F.lit(""))
    instruction = F.concat(F.concat_ws("; ", F.concat(F.lit("A "), who, F.lit(" voice")), F.concat(traits, F.lit(" personality")), spoken, F.lit(DELIVERY)), F.lit("."))
    return description, instruction


def narrator_summary(name: Column, stage: Column, gender: Column, accent_: Column) -> Column:
    part = lambda c: F.when(~F.coalesce(c, F.lit("")).isin("", "unknown"), F.replace(c, F.lit("_"), F.lit(" ")))
    rest = F.concat_ws(" ", part(stage), part(gender), part(accent_))
    return F.concat(F.coalesce(F.nullif(F.btrim(name), F.lit("")), F.lit("Narrator")), F.lit(": "), F.when(rest == "", "custom narrator").otherwise(rest))


def last_read_label(chapter: Column, unit: Column) -> Column:
    c = F.btrim(F.coalesce(chapter, F.lit("")))
    return F.when(c == "", "Not started").when(unit.isNull(), c).otherwise(F.concat(c, F.lit(", segment "), (unit + 1).cast("string")))


def is_narrator() -> Column:
    """Whether a unit (role, role_id, voice_variant) is read by the narrator, under its present or its older name."""
    said = lambda c, *names: F.coalesce(F.col(c).isin(*names), F.lit(False))
    return said("role_id", "functional_narrator", "narrator") | said("voice_variant", "functional_narrator") | said("role", "Narrator")


def is_temp(path: Column) -> Column:
    """Whether a voice belongs to a chapter alone."""
    return F.startswith(F.replace(F.btrim(F.coalesce(path, F.lit(""))), F.lit("\\"), F.lit("/")), F.lit("voices/_temp/"))
