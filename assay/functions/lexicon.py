"""Lexicons for the refusal (H7) and hedging (H8) scorers, as a parameter table.

A lexicon is a small DataFrame ``(language, role, stem, word)``: ``word`` is an
inflected surface form as it stands in a text, ``stem`` the entry it counts for.
Roles: ``negation``, ``capability``, ``self_negating`` (refusal) and ``solo``,
``verb``, ``subject`` (hedging). Language order decides which language is
reported first.

No stemmer runs over the corpus. The forms of an entry come from a rule: roots
of the entry, each with the endings of its class (the regular conjugations and
derivations of the language). A word that is no form of the table counts for no
entry, also where a stemmer would cut it to the same letters (``nevering``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# fixed values: language order of the lexicon scorers
LANGUAGES = ("english", "portuguese", "spanish")

# fixed values: Snowball stems of the refusal and hedging lexicons, per language
NEGATION = {
    "english": ("not", "n't", "no", "never", "neither"),
    "portuguese": ("nã", "no", "nunc", "nem"),
    "spanish": ("no", "nunc", "ni", "jamas"),
}
CAPABILITY = {
    "english": ("have", "can", "find", "know", "possess", "provid", "help", "assist"),
    "portuguese": ("tenh", "possu", "consig", "encontr", "pod", "sab", "hav"),
    "spanish": ("teng", "pued", "encontr", "sab", "cont", "hav"),
}
SELF_NEGATING = ("unabl", "imposs", "impossív")
HEDGING_SOLO = {
    "english": ("mayb", "perhap", "possibl", "probabl", "unclear", "uncertain", "unsur", "appar"),
    "portuguese": ("talvez", "possivel", "provavel", "incert", "aparent"),
    "spanish": ("quiz", "quizas", "posibl", "probabl", "inciert", "aparent"),
}
HEDGING_VERB = {
    "english": ("think", "believ", "seem", "appear", "guess", "suppos", "doubt"),
    "portuguese": ("acho", "parec", "duv", "acredit", "suponh"),
    "spanish": ("cre", "parec", "dud", "supong"),
}
HEDGING_SUBJECT = {
    "english": ("i", "it"),
    "portuguese": ("eu", "me"),
    "spanish": ("yo", "me"),
}
# fixed values: proximity windows (tokens on each side)
REFUSAL_WINDOW = 4
HEDGING_WINDOW = 3

# Classes of endings ("-" is the bare root), the regular paradigms of each language.
ENDINGS = {
    "word": "-",
    "en verb": "- s ed ing",
    "en verb es": "- es ed ing",
    "en verb e": "e es ed ing",
    "pt ar": "o as a amos ais am ar ares armos arem ando ado ada ados adas ei aste ou aram ava avas ávamos avam "
             "ara aras áramos arei arás ará aremos arão aria arias aríamos ariam e es emos em asse asses ássemos assem",
    "pt er": "e es emos eis em er eres ermos erem endo ido ida idos idas i este eu eram ia ias íamos iam "
             "erei erás erá eremos erão eria erias eríamos eriam",
    "pt subjunctive": "o a as amos am",
    "es ar": "o as a amos áis an ar ando ado ada ados adas é aste ó asteis aron aba abas ábamos aban "
             "aré arás ará aremos arán aría arías aríamos arían e es emos en ara aras áramos aran ase ases ásemos asen",
    "es er": "es e emos éis en er iendo ido ida idos idas ía ías íamos ían í iste ió imos ieron "
             "eré erás erá eremos erán ería erías eríamos erían",
    "es present": "o a as amos an",
    "adjective": "o a os as",
    "plural": "- s",
}
# Roots and classes of the entries; an entry without a line is a word of its own.
INFLECTIONS = {
    "english": {
        "have": "hav:en verb e", "can": "can:plural", "find": "find:en verb findings:word", "know": "know:en verb",
        "possess": "possess:en verb es possession:plural", "provid": "provid:en verb e provider:plural",
        "help": "help:en verb helpful:word helpfully:word", "assist": "assist:en verb assistance:word assistant:plural",
        "unabl": "unable:word", "imposs": "impossible:word impossibly:word impossibility:word impossibilities:word",
        "mayb": "maybe:word", "perhap": "perhaps:word",
        "possibl": "possible:word possibly:word possibility:word possibilities:word",
        "probabl": "probable:word probably:word probability:word probabilities:word",
        "unclear": "unclear:word unclearly:word", "uncertain": "uncertain:word uncertainly:word", "unsur": "unsure:word",
        "appar": "apparent:word apparently:word", "think": "think:en verb", "believ": "believ:en verb e",
        "seem": "seem:en verb seemingly:word", "appear": "appear:en verb appearance:plural", "guess": "guess:en verb es",
        "suppos": "suppos:en verb e supposedly:word", "doubt": "doubt:en verb doubtful:word doubtfully:word",
        "it": "it:word its:word",
    },
    "portuguese": {
        "nã": "não:word", "nunc": "nunca:word", "tenh": "tenh:pt subjunctive",
        "possu": "possuo:word possui:plural possuem:word possuir:word possuindo:word possuiu:word possua:plural possuam:word",
        "consig": "consig:pt subjunctive", "encontr": "encontr:pt ar", "pod": "pod:pt er", "sab": "sab:pt er",
        "hav": "hav:pt er", "impossív": "impossível:word impossíveis:word",
        "possivel": "possivelmente:word", "provavel": "provavelmente:word",
        "incert": "incert:adjective incerteza:plural",
        "aparent": "aparente:plural aparentemente:word aparent:pt ar", "parec": "parec:pt er",
        "duv": "duvid:adjective", "acredit": "acredit:pt ar", "suponh": "suponh:pt subjunctive",
    },
    "spanish": {
        "nunc": "nunca:word", "jamas": "jamás:word", "teng": "teng:es present",
        "pued": "pued:es present pued:es er", "encontr": "encontr:es ar", "sab": "sab:es er", "cont": "cont:es ar",
        "hav": "hav:es er", "quiz": "quizá:word quiza:plural", "quizas": "quizás:word",
        "posibl": "posible:plural posiblemente:word", "probabl": "probable:plural probablemente:word",
        "inciert": "inciert:adjective", "aparent": "aparente:plural aparentemente:word aparent:es ar",
        "cre": "creo:word cre:es er", "parec": "parec:es er", "dud": "dud:es ar", "supong": "supong:es present",
    },
}

LEXICON_SCHEMA = "language string, role string, stem string, word string"


def forms(language: str, stem: str) -> list[str]:
    """The surface forms of an entry, without repeats, in the order of the classes."""
    spec = INFLECTIONS[language].get(stem)
    if spec is None:
        return [stem]
    out: dict[str, None] = {}
    root = None
    for part in spec.split():
        if ":" in part:  # root:class; the words of a class's name follow
            if root is not None:
                out.update(dict.fromkeys(_inflect(root, name)))
            root, name = part.split(":")
        else:
            name += " " + part
    out.update(dict.fromkeys(_inflect(root, name)))
    return list(out)


def _inflect(root: str, name: str) -> list[str]:
    return [root + ("" if e == "-" else e) for e in ENDINGS[name].split()]


def default_rows() -> list[tuple[str, str, str, str]]:
    entries = []
    for lang in LANGUAGES:
        entries += [(lang, "negation", s) for s in NEGATION[lang]]
        entries += [(lang, "capability", s) for s in CAPABILITY[lang]]
        # self-negating entries belong to the language that has their forms
        entries += [(lang, "self_negating", s) for s in SELF_NEGATING if s in INFLECTIONS[lang]]
        entries += [(lang, "solo", s) for s in HEDGING_SOLO[lang]]
        entries += [(lang, "verb", s) for s in HEDGING_VERB[lang]]
        entries += [(lang, "subject", s) for s in HEDGING_SUBJECT[lang]]
    return [(lang, role, stem, word) for lang, role, stem in entries for word in forms(lang, stem)]


def default_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(default_rows(), LEXICON_SCHEMA)


def lexicon_values_sql(rows) -> str:
    """``VALUES`` list for the oracle SQL."""
    def q(s):
        return "'" + s.replace("'", "''") + "'"
    return ",\n    ".join("(" + ", ".join(map(q, row)) + ")" for row in rows)
