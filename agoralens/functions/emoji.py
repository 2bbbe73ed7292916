"""Emoji short names, derived from the Unicode names plus a list of overrides.

The text form of an emoji is ``:short_name:``.  Most short names are the
Unicode name in lower case with underscores; the overrides below are those that
are not.  Flags are named by their regions.  Joined sequences of people are named by
their parts' rules, others are listed, and what remains is named part by part; keycaps
stay as they are.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from functools import cache

from pyspark.sql import SparkSession

# The code points that the Unicode emoji list names, but for digits and marks.
RANGES = [
    (0xA9, 0xA9), (0xAE, 0xAE), (0x203C, 0x203C), (0x2049, 0x2049), (0x2122, 0x2122), (0x2139, 0x2139),
    (0x2194, 0x2199), (0x21A9, 0x21AA), (0x231A, 0x231B), (0x2328, 0x2328), (0x23CF, 0x23CF), (0x23E9, 0x23F3),
    (0x23F8, 0x23FA), (0x24C2, 0x24C2), (0x25AA, 0x25AB), (0x25B6, 0x25B6), (0x25C0, 0x25C0), (0x25FB, 0x25FE),
    (0x2600, 0x2604), (0x260E, 0x260E), (0x2611, 0x2611), (0x2614, 0x2615), (0x2618, 0x2618), (0x261D, 0x261D),
    (0x2620, 0x2620), (0x2622, 0x2623), (0x2626, 0x2626), (0x262A, 0x262A), (0x262E, 0x262F), (0x2638, 0x263A),
    (0x2640, 0x2640), (0x2642, 0x2642), (0x2648, 0x2653), (0x265F, 0x2660), (0x2663, 0x2663), (0x2665, 0x2666),
    (0x2668, 0x2668), (0x267B, 0x267B), (0x267E, 0x267F), (0x2692, 0x2697), (0x2699, 0x2699), (0x269B, 0x269C),
    (0x26A0, 0x26A1), (0x26A7, 0x26A7), (0x26AA, 0x26AB), (0x26B0, 0x26B1), (0x26BD, 0x26BE), (0x26C4, 0x26C5),
    (0x26C8, 0x26C8), (0x26CE, 0x26CF), (0x26D1, 0x26D1), (0x26D3, 0x26D4), (0x26E9, 0x26EA), (0x26F0, 0x26F5),
    (0x26F7, 0x26FA), (0x26FD, 0x26FD), (0x2702, 0x2702), (0x2705, 0x2705), (0x2708, 0x270D), (0x270F, 0x270F),
    (0x2712, 0x2712), (0x2714, 0x2714), (0x2716, 0x2716), (0x271D, 0x271D), (0x2721, 0x2721), (0x2728, 0x2728),
    (0x2733, 0x2734), (0x2744, 0x2744), (0x2747, 0x2747), (0x274C, 0x274C), (0x274E, 0x274E), (0x2753, 0x2755),
    (0x2757, 0x2757), (0x2763, 0x2764), (0x2795, 0x2797), (0x27A1, 0x27A1), (0x27B0, 0x27B0), (0x27BF, 0x27BF),
    (0x2934, 0x2935), (0x2B05, 0x2B07), (0x2B1B, 0x2B1C), (0x2B50, 0x2B50), (0x2B55, 0x2B55), (0x3030, 0x3030),
    (0x303D, 0x303D), (0x3297, 0x3297), (0x3299, 0x3299), (0x1F004, 0x1F004), (0x1F0CF, 0x1F0CF),
    (0x1F170, 0x1F171), (0x1F17E, 0x1F17F), (0x1F18E, 0x1F18E), (0x1F191, 0x1F19A), (0x1F1E6, 0x1F1FF),
    (0x1F201, 0x1F202), (0x1F21A, 0x1F21A), (0x1F22F, 0x1F22F), (0x1F232, 0x1F23A), (0x1F250, 0x1F251),
    (0x1F300, 0x1F321), (0x1F324, 0x1F393), (0x1F396, 0x1F397), (0x1F399, 0x1F39B), (0x1F39E, 0x1F3F0),
    (0x1F3F3, 0x1F3F5), (0x1F3F7, 0x1F4FD), (0x1F4FF, 0x1F53D), (0x1F549, 0x1F54E), (0x1F550, 0x1F567),
    (0x1F56F, 0x1F570), (0x1F573, 0x1F57A), (0x1F587, 0x1F587), (0x1F58A, 0x1F58D), (0x1F590, 0x1F590),
    (0x1F595, 0x1F596), (0x1F5A4, 0x1F5A5), (0x1F5A8, 0x1F5A8), (0x1F5B1, 0x1F5B2), (0x1F5BC, 0x1F5BC),
    (0x1F5C2, 0x1F5C4), (0x1F5D1, 0x1F5D3), (0x1F5DC, 0x1F5DE), (0x1F5E1, 0x1F5E1), (0x1F5E3, 0x1F5E3),
    (0x1F5E8, 0x1F5E8), (0x1F5EF, 0x1F5EF), (0x1F5F3, 0x1F5F3), (0x1F5FA, 0x1F64F), (0x1F680, 0x1F6C5),
    (0x1F6CB, 0x1F6D2), (0x1F6D5, 0x1F6D7), (0x1F6DC, 0x1F6E5), (0x1F6E9, 0x1F6E9), (0x1F6EB, 0x1F6EC),
    (0x1F6F0, 0x1F6F0), (0x1F6F3, 0x1F6FC), (0x1F7E0, 0x1F7EB), (0x1F7F0, 0x1F7F0), (0x1F90C, 0x1F93A),
    (0x1F93C, 0x1F945), (0x1F947, 0x1F9FF), (0x1FA70, 0x1FA7C), (0x1FA80, 0x1FA89), (0x1FA8F, 0x1FAC6),
    (0x1FACE, 0x1FADC), (0x1FADF, 0x1FAE9), (0x1FAF0, 0x1FAF8),
]
VARIATION = "️"
JOINER = "‍"
# Two of them are the flag of the region whose code they spell.
REGIONAL = [chr(0x1F1E6 + i) for i in range(26)]
# Fixed values.
SKIN_TONES = {
    "\U0001F3FB": "light_skin_tone",
    "\U0001F3FC": "medium-light_skin_tone",
    "\U0001F3FD": "medium_skin_tone",
    "\U0001F3FE": "medium-dark_skin_tone",
    "\U0001F3FF": "dark_skin_tone",
}
OVERRIDES = {
    "❤": "red_heart",
    "🖤": "black_heart",
    "💔": "broken_heart",
    "💗": "growing_heart",
    "💘": "heart_with_arrow",
    "💝": "heart_with_ribbon",
    "💞": "revolving_hearts",
    "💟": "heart_decoration",
    "👍": "thumbs_up",
    "👎": "thumbs_down",
    "👌": "OK_hand",
    "👏": "clapping_hands",
    "🙌": "raising_hands",
    "🙏": "folded_hands",
    "💪": "flexed_biceps",
    "👊": "oncoming_fist",
    "✊": "raised_fist",
    "✋": "raised_hand",
    "👋": "waving_hand",
    "🤟": "love-you_gesture",
    "👉": "backhand_index_pointing_right",
    "👈": "backhand_index_pointing_left",
    "👆": "backhand_index_pointing_up",
    "👇": "backhand_index_pointing_down",
    "☝": "index_pointing_up",
    "✌": "victory_hand",
    "🎉": "party_popper",
    "😀": "grinning_face",
    "😃": "grinning_face_with_big_eyes",
    "😄": "grinning_face_with_smiling_eyes",
    "😁": "beaming_face_with_smiling_eyes",
    "😆": "grinning_squinting_face",
    "😅": "grinning_face_with_sweat",
    "🤣": "rolling_on_the_floor_laughing",
    "🙂": "slightly_smiling_face",
    "🙃": "upside-down_face",
    "😍": "smiling_face_with_heart-eyes",
    "😘": "face_blowing_a_kiss",
    "😋": "face_savoring_food",
    "😛": "face_with_tongue",
    "😜": "winking_face_with_tongue",
    "😝": "squinting_face_with_tongue",
    "😒": "unamused_face",
    "🙄": "face_with_rolling_eyes",
    "😬": "grimacing_face",
    "😔": "pensive_face",
    "😪": "sleepy_face",
    "😷": "face_with_medical_mask",
    "😵": "face_with_crossed-out_eyes",
    "😎": "smiling_face_with_sunglasses",
    "😟": "worried_face",
    "🙁": "slightly_frowning_face",
    "☹": "frowning_face",
    "☺": "smiling_face",
    "😮": "face_with_open_mouth",
    "😦": "frowning_face_with_open_mouth",
    "😨": "fearful_face",
    "😰": "anxious_face_with_sweat",
    "😥": "sad_but_relieved_face",
    "😓": "downcast_face_with_sweat",
    "😤": "face_with_steam_from_nose",
    "😡": "enraged_face",
    "😱": "face_screaming_in_fear",
    "💩": "pile_of_poo",
    "💀": "skull",
    "💯": "hundred_points",
    "💥": "collision",
    "💦": "sweat_droplets",
    "💨": "dashing_away",
    "💫": "dizzy",
    "💤": "ZZZ",
    "🙈": "see-no-evil_monkey",
    "🙉": "hear-no-evil_monkey",
    "🙊": "speak-no-evil_monkey",
    "⭐": "star",
    "🌟": "glowing_star",
    "✨": "sparkles",
    "✅": "check_mark_button",
    "✔": "check_mark",
    "❌": "cross_mark",
    "❓": "red_question_mark",
    "❗": "red_exclamation_mark",
    "⚡": "high_voltage",
    "☀": "sun",
    "⚠": "warning",
    "🚀": "rocket",
    "🍺": "beer_mug",
    "🍻": "clinking_beer_mugs",
    "🎂": "birthday_cake",
    "🎁": "wrapped_gift",
    "🎄": "Christmas_tree",
    "🎅": "Santa_Claus",
    "📈": "chart_increasing",
    "📉": "chart_decreasing",
    "🐶": "dog_face",
    "🐱": "cat_face",
    "🤷": "person_shrugging",
    "🤦": "person_facepalming",
    "❤️‍🔥": "heart_on_fire",
    "🏳️‍🌈": "rainbow_flag",
    "🤷‍♂️": "man_shrugging",
    "🤷‍♀️": "woman_shrugging",
    "🤦‍♂️": "man_facepalming",
    "🤦‍♀️": "woman_facepalming",
    "♥": "heart_suit",
    "♠": "spade_suit",
    "♦": "diamond_suit",
    "♣": "club_suit",
    "👽": "alien",
    "🤖": "robot",
    "👿": "angry_face_with_horns",
    "😈": "smiling_face_with_horns",
    "😺": "grinning_cat",
    "😸": "grinning_cat_with_smiling_eyes",
    "😹": "cat_with_tears_of_joy",
    "😻": "smiling_cat_with_heart-eyes",
    "🎶": "musical_notes",
    "🎵": "musical_note",
    "❣": "heart_exclamation",
    "™": "trade_mark",
    "©": "copyright",
    "®": "registered",
    "⬆": "up_arrow",
    "⬇": "down_arrow",
    "⬅": "left_arrow",
    "➡": "right_arrow",
    "▶": "play_button",
    "◀": "reverse_button",
    "🅰": "A_button_(blood_type)",
    "🅱": "B_button_(blood_type)",
    "🅾": "O_button_(blood_type)",
    "🅿": "P_button",
    "🆎": "AB_button_(blood_type)",
    "🆗": "OK_button",
    "🆒": "COOL_button",
    "🆕": "NEW_button",
    "🆓": "FREE_button",
    "🆘": "SOS_button",
    "🔴": "red_circle",
    "🔵": "blue_circle",
    "🟠": "orange_circle",
    "🟡": "yellow_circle",
    "🟢": "green_circle",
    "🟣": "purple_circle",
    "🟤": "brown_circle",
    "🟥": "red_square",
    "🟦": "blue_square",
    "🟧": "orange_square",
    "🟨": "yellow_square",
    "🟩": "green_square",
    "🟪": "purple_square",
    "🟫": "brown_square",
    "⚪": "white_circle",
    "⚫": "black_circle",
    "‼": "double_exclamation_mark",
    "⁉": "exclamation_question_mark",
    "ℹ": "information",
    "☎": "telephone",
    "☑": "check_box_with_check",
    "✖": "multiply",
    "❎": "cross_mark_button",
}

# What a person joined to an object is called.
PEOPLE = {"👨": "man", "👩": "woman", "🧑": ""}
ROLES = {
    "⚕": "health_worker", "⚖": "judge", "✈": "pilot", "🌾": "farmer", "🍳": "cook", "🍼": "feeding_baby",
    "🎓": "student", "🎤": "singer", "🎨": "artist", "🏫": "teacher", "🏭": "factory_worker", "💻": "technologist",
    "💼": "office_worker", "🔧": "mechanic", "🔬": "scientist", "🚀": "astronaut", "🚒": "firefighter",
    "🦯": "with_white_cane", "🦼": "in_motorized_wheelchair", "🦽": "in_manual_wheelchair", "🦰": "red_hair",
    "🦱": "curly_hair", "🦲": "bald", "🦳": "white_hair",
}
# What a person with a gender's sign is called after it.
GENDERS = {"♂": ("man", "men"), "♀": ("woman", "women")}
ACTIVITIES = {
    "⛹": "bouncing_ball", "🏃": "running", "🏄": "surfing", "🏊": "swimming", "🏋": "lifting_weights", "🏌": "golfing",
    "👮": "police_officer", "👰": "with_veil", "👱": "blond_hair", "👳": "wearing_turban", "👷": "construction_worker",
    "💁": "tipping_hand", "💂": "guard", "💆": "getting_massage", "💇": "getting_haircut", "🕵": "detective",
    "🙅": "gesturing_NO", "🙆": "gesturing_OK", "🙇": "bowing", "🙋": "raising_hand", "🙍": "frowning", "🙎": "pouting",
    "🚣": "rowing_boat", "🚴": "biking", "🚵": "mountain_biking", "🚶": "walking", "🤦": "facepalming",
    "🤵": "in_tuxedo", "🤷": "shrugging", "🤸": "cartwheeling", "🤹": "juggling", "🤽": "playing_water_polo",
    "🤾": "playing_handball", "🦸": "superhero", "🦹": "supervillain", "🧍": "standing", "🧎": "kneeling",
    "🧏": "deaf", "🧔": "beard", "🧖": "in_steamy_room", "🧗": "climbing", "🧘": "in_lotus_position", "🧙": "mage",
    "🧚": "fairy", "🧛": "vampire", "🧝": "elf", "🧞": "genie", "🧟": "zombie",
}
# The other joined sequences.
JOINED = {
    "👁‍🗨": "eye_in_speech_bubble", "🏳‍⚧": "transgender_flag", "🏴‍☠": "pirate_flag", "❤‍🩹": "mending_heart",
    "🐕‍🦺": "service_dog", "🐈‍⬛": "black_cat", "🐻‍❄": "polar_bear", "🐦‍⬛": "black_bird", "😮‍💨": "face_exhaling",
    "😵‍💫": "face_with_spiral_eyes", "😶‍🌫": "face_in_clouds", "🧜‍♀": "mermaid", "🧜‍♂": "merman",
    "👯‍♀": "women_with_bunny_ears", "👯‍♂": "men_with_bunny_ears", "🤼‍♀": "women_wrestling", "🤼‍♂": "men_wrestling",
    "🧑‍🎄": "mx_claus", "🐦‍🔥": "phoenix", "🍋‍🟩": "lime", "🍄‍🟫": "brown_mushroom", "⛓‍💥": "broken_chain",
    "🙂‍↔": "head_shaking_horizontally", "🙂‍↕": "head_shaking_vertically", "🧑‍🤝‍🧑": "people_holding_hands",
}
HEART, KISS = "❤", "💋"
CHILDREN = {"👦": "boy", "👧": "girl"}


@cache
def joined_names() -> dict[str, str]:
    """Joined sequences (without variation selectors) to their short names, with one skin tone where people take one."""
    names = {s.replace(VARIATION, ""): n for s, n in OVERRIDES.items() if JOINER in s} | JOINED
    tones = {"": "", **{t: f"_{n}" for t, n in SKIN_TONES.items()}}
    for tone, suffix in tones.items():
        for person, who in PEOPLE.items():
            for thing, role in ROLES.items():
                name = "_".join(p for p in (who or ("person" if role.split("_")[-1] in ("hair", "bald", "cane", "wheelchair", "baby") else ""), role) if p)
                names[person + tone + JOINER + thing] = name + suffix
        for sign, (one, _) in GENDERS.items():
            for person, activity in ACTIVITIES.items():
                names[person + tone + JOINER + sign] = f"{one}_{activity}{suffix}"
    adults = {s: n for s, n in PEOPLE.items() if n}
    pairs = [(a, b) for a in adults for b in adults]
    for a, b in pairs:
        between = f"{adults[a]}_{adults[b]}"
        names[JOINER.join((a, HEART, b))] = f"couple_with_heart_{between}"
        names[JOINER.join((a, HEART, KISS, b))] = f"kiss_{between}"
    parents = [(a,) for a in adults] + [p for p in pairs if p != ("👩", "👨")]
    offspring = [(c,) for c in CHILDREN] + [("👧", "👦"), ("👦", "👦"), ("👧", "👧")]
    for family in (p + c for p in parents for c in offspring):
        names[JOINER.join(family)] = "_".join(["family", *((adults | CHILDREN)[m] for m in family)])
    return names


@cache
def short_names() -> dict[str, str]:
    """Emoji sequence (without variation selectors) to its short name."""
    names = {}
    for first, last in RANGES:
        for point in range(first, last + 1):
            symbol = chr(point)
            name = unicodedata.name(symbol, "")
            if name and symbol not in REGIONAL:
                names[symbol] = name.lower().replace(" ", "_")
    for symbol, tone in SKIN_TONES.items():
        names[symbol] = tone
    for sequence, name in OVERRIDES.items():
        names[sequence.replace(VARIATION, "")] = name
    return names


def _class(extra: str = "") -> str:
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in RANGES) + extra + "]"


SYMBOL = _class()
# All of the ranges and little else, in three: what a text without symbols is looked through for.
POSSIBLE = r"[\x{A9}\x{AE}\x{203C}-\x{3299}\x{1F004}-\x{1FAF8}]"


def _trie_pattern(sequences: list[str]) -> str:
    """A pattern of the listed sequences in which each prefix stands once and the longest match comes first."""
    trie: dict = {}
    for sequence in sequences:
        node = trie
        for c in sequence:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        ways = [c + ("" if c == JOINER else f"{VARIATION}?") + pattern(below) for c, below in sorted(node.items()) if c]
        if not ways:
            return ""
        return "(?:" + "|".join(ways) + ")" + ("?" if "" in node else "")

    return pattern(trie)


# Splits a text into single emoji (joined sequences first, then one symbol with an
# optional skin tone) and the runs between them.
PIECES = (
    rf"(?:{_trie_pattern(list(joined_names()))}|[{REGIONAL[0]}-{REGIONAL[-1]}]{{2}}|{SYMBOL}(?:[\x{{1F3FB}}-\x{{1F3FF}}])?){VARIATION}?"
    rf"|[^{SYMBOL[1:]}+"
)


def flags() -> dict[str, str]:
    """Flag to the English name of its region, as the Java runtime's copy of the locale data has it."""
    locale = SparkSession.active()._jvm.java.util.Locale
    spelt = {code: "".join(REGIONAL[ord(c) - ord("A")] for c in code) for code in locale.getISOCountries()}
    return {f: locale("", c).getDisplayCountry(locale.ENGLISH).replace(" ", "_") for c, f in spelt.items()}


MAPS = 256


@cache
def short_names_json() -> str:
    """The names, with every skin tone of the symbols that take one, in maps chosen by a checksum of the sequence."""
    names = dict(short_names())
    for symbol, name in short_names().items():
        if len(symbol) == 1 and symbol not in SKIN_TONES and _takes_tone(symbol):
            for tone, suffix in SKIN_TONES.items():
                names[symbol + tone] = f"{name}_{suffix}"
    names.update(joined_names())
    names.update(flags())
    maps: list[dict[str, str]] = [{} for _ in range(MAPS)]
    for sequence, name in names.items():
        maps[zlib.crc32(sequence.encode()) % MAPS][sequence] = name
    return json.dumps(maps, ensure_ascii=False)


def _takes_tone(symbol: str) -> bool:
    name = unicodedata.name(symbol, "")
    return any(w in name for w in ("HAND", "FIST", "FINGER", "THUMBS", "PERSON", "MAN", "WOMAN", "BOY",
                                   "GIRL", "BABY", "BICEPS", "SHRUG", "FACE PALM", "INDEX"))
