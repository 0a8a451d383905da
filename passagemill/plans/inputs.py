"""Inline inputs of the registered queries."""

LETTER_ROWS = [
    (1, "بِسْمِ ٱللَّهِ"), (2, "إيمان، أحمد"), (3, "صلاة؟ (زكاة)"), (4, "موسى ؤئ"), (5, "کتاب گل ہے"), (6, "١٢٣ ۴۵۶"), (7, "abc مرحبا"), (8, "Latin only"), (9, ""), (10, "شيء‌ـط"),
]
TERMS = {"q1": ["the", "that", "and"], "q2": ["der", "und", "die"], "q3": ["les", "des", "des"], "q4": ["que", "los"], "q5": ["idiot", "clown"]}
FIELD_TERMS = {"f1": ["the", "src1", "en"], "f2": ["der", "de", "src3"], "f3": ["les", "fr"]}
SYNONYMS = {"the": ["die", "les"], "and": ["und", "que"], "of": ["von"]}
COUNTED = ["the", "that", "der", "les", "que", "idiot"]
LISTED = ["idiot", "clown"]
REFERENCES = [
    (1, "2:3"), (2, " 3 : 1 - 4 "), (3, "4/2"), (4, "surah 5 ayah 3"), (5, "verse 6:2"), (6, "chapter 7 verse 1"), (7, "8 2"), (8, "9"), (9, "115:1"), (10, "2:300"),
    (11, "10:4-2"), (12, "verse 2:2-5"), (13, "nothing here"), (14, "0:1"), (15, "11.1"), (16, "114"), (17, "115"), (18, "12,3 to 5"), (19, "throne verse"), (20, "surah opening"),
    (21, "the cow 3"), (22, "light"), (23, "light verse"), (24, "a night in the cave"),
]
NICKNAMES = {"throne verse": "2:255"}
STRICT = [("opening", 1), ("cow", 2), ("the cow", 2)]
LOOSE = [("light", 24), ("cave", 18), ("night", 92)]
TARGETS = [("opening", "1:1-3"), ("mixed", "2:1, 4-6,9, bad"), ("back", "7:5-2"), ("single", "3:2")]
RANGES = [("short", 0, 499, 0), ("medium", 500, 1999, 1), ("overlap", 400, 600, 2), ("long", 2000, 9999, 3)]
TRIGGERS = [("insult", "en", "idiot"), ("insult", "de", "achlichch"), ("insult", "fr", "des"), ("bad", "en", "scum"), ("bad", "es", "los")]
VARIANTS = [("idiot", "moron"), ("scum", "trash"), ("scum", "loser")]
NEGATIVES = [("insult", "en", "clown"), ("bad", "en", "stupid")]
ANCHORS = [("insult", 0, 1), ("insult", 5, 7), ("bad", 1, 1), ("empty", 2, 2)]
SEEDS = [("the", "teh"), ("the", "The"), ("and", "&"), ("and", "et"), ("der", "Der"), ("idiot", "fool")]
PHRASES = [(1, ["of", "the"]), (2, ["the", "of", "and"]), (3, ["und", "der"]), (4, ["that", "that"])]
GRID = [0.2, 0.3, 0.4]
RANGE_ROWS = [("1", "1:1", "1:7"), ("2", "2:1", "2:9"), ("2", "2:10", "2:20"), ("x", "3:1", "3:2"), ("9", "1:1", "1:2"), ("3", "3:2", "3:99"), ("4", "bad", "3:10")]
