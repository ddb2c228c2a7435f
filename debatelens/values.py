"""Fixed values that decide results: names, word lists, orders and cut-offs.

Everything here is a constant of the message data model. Operators take them as
defaults and accept others as parameters.
"""

from __future__ import annotations

# --- Fixed values: escalation levels, in report order, and their ordinals ---
LEVELS = ["none", "light", "strong"]
LEVEL_ORDINALS = {"none": 0, "light": 1, "strong": 2}

# --- Fixed values: host modes ---
MODES = ["neutral", "provocative", "extreme"]
PROCON_PREFIX = "pro-con"
PROCON_MODES = ["pro-con-neutral", "pro-con-provocative", "pro-con-extreme"]

# --- Fixed values: speakers ---
HOST = "Host"
BOTS = ["Bot 1", "Bot 2"]
PROCON_BOTS = ["Pro-Bot", "Con-Bot"]

# --- Fixed values: topic catalogue, in report order ---
TOPICS = [
    "Politics",
    "Social Issues",
    "Religion",
    "Economy",
    "Technology",
    "Climate Change",
    "Human Rights",
    "Education",
]

# --- Fixed values: blanks that are cut from the ends of names and texts ---
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# --- Fixed values: host strategies, in round-robin order ---
STRATEGIES = ["fact_check", "false_claim", "bot_comparison", "follow_up", "redirect"]

# --- Fixed values: reason families, first match wins, "Other" matches the rest ---
REASON_FAMILIES = ["VADER", "DistilBERT", "Transformer", "TextBlob", "Other"]

# --- Fixed values: classifier labels ---
POSITIVE, NEGATIVE, UNKNOWN = "POSITIVE", "NEGATIVE", "UNKNOWN"
MODEL_LABELS = [POSITIVE, NEGATIVE, UNKNOWN]
TOXIC = "TOXIC"

# --- Fixed values: characters passed to a classifier, shown in a preview ---
MODEL_INPUT_CHARS = 512
PREVIEW_CHARS = 60

# --- Fixed values: escalation phrases ---
ESCALATION_PHRASES = [
    "idiot", "stupid", "nonsense", "shut up", "you don't understand",
    "propaganda", "hate", "ignorant", "fool", "trash", "insult", "disgrace",
    "moron", "dumb", "worthless", "clueless", "pathetic", "loser", "garbage",
    "nobody cares", "get lost", "useless", "annoying", "ridiculous", "absurd",
    "what's wrong with you", "are you serious", "how dare you", "shame on you",
]

# --- Fixed values: word lists of the published valence method (Hutto & Gilbert 2014) ---
NEGATORS = [
    "aint", "arent", "cannot", "cant", "couldnt", "darent", "didnt", "doesnt",
    "ain't", "aren't", "can't", "couldn't", "daren't", "didn't", "doesn't",
    "dont", "hadnt", "hasnt", "havent", "isnt", "mightnt", "mustnt", "neither",
    "don't", "hadn't", "hasn't", "haven't", "isn't", "mightn't", "mustn't",
    "neednt", "needn't", "never", "none", "nope", "nor", "not", "nothing",
    "nowhere", "oughtnt", "shant", "shouldnt", "uhuh", "wasnt", "werent",
    "oughtn't", "shan't", "shouldn't", "uh-uh", "wasn't", "weren't",
    "without", "wont", "wouldnt", "won't", "wouldn't", "rarely", "seldom", "despite",
]
BOOSTERS_UP = [
    "absolutely", "amazingly", "awfully", "completely", "considerably",
    "decidedly", "deeply", "effing", "enormously", "entirely", "especially",
    "exceptionally", "extremely", "fabulously", "flipping", "flippin",
    "fricking", "frickin", "frigging", "friggin", "fully", "fucking", "greatly",
    "hella", "highly", "hugely", "incredibly", "intensely", "majorly", "more",
    "most", "particularly", "purely", "quite", "really", "remarkably", "so",
    "substantially", "thoroughly", "totally", "tremendously", "uber",
    "unbelievably", "unusually", "utterly", "very",
]
BOOSTERS_DOWN = [
    "almost", "barely", "hardly", "just enough", "kind of", "kinda", "kindof",
    "kind-of", "less", "little", "marginally", "occasionally", "partly",
    "scarcely", "slightly", "somewhat", "sort of", "sorta", "sortof", "sort-of",
]
IDIOMS = {
    "the shit": 3.0, "the bomb": 3.0, "bad ass": 1.5, "bus stop": 0.0, "yeah right": -2.0,
    "cut the mustard": 2.0, "kiss of death": -1.5, "hand to mouth": -2.0,
}
