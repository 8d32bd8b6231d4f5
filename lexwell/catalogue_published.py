"""Published words and what they must become: the queries that compare stemmers, codes and the detector with them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexwell.catalogue import query
from lexwell.functions.analyzers import ANALYZERS
from lexwell.functions.detect import detect
from lexwell.sources.shipping import ship

# Words and the stems they must have. Numbers and identifiers stay as they are in every language.
STEMS = {
    "da": {"hundene": "hund", "hunds": "hund", "kvinden": "kvind", "bogen": "bog", "venligst": "ven", "frygteligt": "frygt", "hoppen": "hop",
        "frihedens": "frihed", "blandt": "bland", "modløst": "modløs", "100": "100", "2011": "2011", "2000": "2000"},
    "de": {"rechnungen": "rechnung", "aufeinander": "aufeinand", "kinder": "kind", "kindes": "kind", "katzen": "katz", "häuser": "haus",
        "gläser": "glas", "bedürfnisse": "bedurfnis", "längst": "lang", "verbindungen": "verbind", "verständlich": "verstand",
        "verantwortlichkeit": "verantwort", "auffällig": "auffall", "wenige": "wenig", "bauen": "bau", "abenteuer": "abenteu", "100": "100",
        "2011": "2011", "2000": "2000"},
    "en": {"running": "run", "knitting": "knit", "hopping": "hop", "hoping": "hope", "agreed": "agre", "feed": "feed", "flies": "fli", "ties": "tie",
        "cries": "cri", "gas": "gas", "kiwis": "kiwi", "consigned": "consign", "relational": "relat", "rational": "ration", "adjustable": "adjust",
        "replacement": "replac", "hopefulness": "hope", "goodness": "good", "general": "general", "communication": "communic", "arsenal": "arsenal",
        "skis": "ski", "skies": "sky", "dying": "die", "early": "earli", "news": "news", "inning": "inning", "proceed": "proceed", "100": "100",
        "2011": "2011", "2000": "2000"},
    "es": {"gatos": "gat", "niñas": "niñ", "canciones": "cancion", "canción": "cancion", "importancia": "import", "nacionalidad": "nacional",
        "rápidamente": "rapid", "lógica": "logic", "trabajando": "trabaj", "llegué": "lleg", "comieron": "com", "comer": "com", "100": "100",
        "2011": "2011", "2000": "2000"},
    "fi": {"taloissa": "talo", "talot": "talo", "taloon": "talo", "taloissaan": "talo", "taloko": "talo", "talosta": "talo", "kirjat": "kirj",
        "kirjan": "kirj", "edeltäjistään": "edeltäj", "edeltäjiin": "edeltäj", "100": "100", "2011": "2011", "2000": "2000"},
    "fr": {"chevaux": "cheval", "continuité": "continu", "continuer": "continu", "majestueux": "majestu", "majestueuse": "majestu",
        "précieusement": "précieux", "mangeait": "mang", "nationalité": "national", "principalement": "principal", "jouaient": "jou",
        "finissions": "fin", "yeux": "yeux", "nation": "nation", "100": "100", "2011": "2011", "2000": "2000"},
    "hu": {"házak": "ház", "házat": "ház", "háznak": "ház", "házzal": "ház", "házban": "ház", "házaim": "ház", "autók": "autó",
        "babakocsival": "babakocs", "almában": "alm", "100": "100", "2011": "2011", "2000": "2000"},
    "it": {"ragazzi": "ragazz", "abbandonata": "abbandon", "nazionale": "nazional", "felicità": "felic", "velocemente": "veloc",
        "pericolosa": "pericol", "mangiando": "mang", "mangiare": "mang", "lettura": "lettur", "organizzazione": "organizz", "cantavano": "cant",
        "100": "100", "2011": "2011", "2000": "2000"},
    "nl": {"katten": "kat", "boeken": "boek", "appelen": "appel", "werken": "werk", "gekken": "gek", "systemen": "system", "lichaam": "licham",
        "lichamelijke": "licham", "mogelijkheden": "mogelijk", "bedoeling": "bedoel", "grootste": "grootst", "maan": "man", "café": "caf",
        "100": "100", "2011": "2011", "2000": "2000"},
    "no": {"huset": "hus", "jentene": "jent", "guttens": "gutt", "bøkene": "bøk", "serverte": "server", "serverer": "server", "sendt": "send",
        "vennlig": "venn", "hjertelig": "hjert", "verks": "verk", "fiskers": "fisk", "sommers": "sommers", "100": "100", "2011": "2011",
        "2000": "2000"},
    "pt": {"casas": "cas", "meninas": "menin", "nacionalidade": "nacional", "rapidamente": "rapid", "importância": "import",
        "trabalhando": "trabalh", "trabalhava": "trabalh", "cantaram": "cant", "felicidade": "felic", "organização": "organiz", "coração": "coraçã",
        "100": "100", "2011": "2011", "2000": "2000"},
    "ro": {"studenți": "studenț", "studentă": "student", "lucrează": "lucr", "lucrare": "lucr", "frumoasă": "frumoas", "românesc": "român",
        "românească": "român", "națională": "național", "băieți": "băi", "copiii": "copii", "100": "100", "2011": "2011", "2000": "2000"},
    "ru": {"книги": "книг", "книга": "книг", "столы": "стол", "читала": "чита", "читать": "чита", "жизни": "жизн", "красивый": "красив",
        "важность": "важност", "техники": "техник", "ёлка": "елк", "100": "100", "2011": "2011", "2000": "2000"},
    "sv": {"husets": "hus", "flickor": "flick", "flickorna": "flick", "jakten": "jakt", "starkare": "stark", "starkast": "stark",
        "möjligheterna": "möj", "friheten": "frihet", "tryggt": "trygg", "kraftfullt": "kraftfull", "rastlöst": "rastlös", "paket": "paket",
        "nyhet": "nyhet", "100": "100", "2011": "2011", "2000": "2000"},
    "tr": {"kitaplar": "kitap", "kitabımdır": "kitap", "kitabım": "kitap", "evler": "ev", "evdeki": "ev", "evden": "ev", "doktorsunuz": "doktor",
        "gözlerinde": "göz", "100": "100", "2011": "2011", "2000": "2000"},
}
# Words and their phonetic codes.
KOELNER = {
    "müller": "657", "mueller": "657", "meier": "67", "mayer": "67", "schmidt": "862", "schmitt": "862", "breschnew": "17863", "wikipedia": "3412",
    "philipp": "351", "filip": "351", "weiß": "38", "weiss": "38", "heinz": "068",
}
DOUBLE_METAPHONE = {"smith": "SM0", "smyth": "SM0", "thomas": "TMS", "knight": "NT", "night": "NT"}
# Sentences and the languages they must be found to be in.
SENTENCES = {
    "Die Rechnungen sind gestern angekommen und wurden sorgfältig geprüft": "de", "The invoices were received yesterday and have been checked": "en",
    "Les chevaux galopent rapidement à travers la campagne pendant l'été": "fr", "Книги лежат на столе в библиотеке рядом с большим окном": "ru",
}


def _values(pairs: dict[str, str | None], names: str) -> str:
    def quoted(v: str) -> str:
        return "'" + v.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join(f'({quoted(k)}, {quoted(v)})' for k, v in pairs.items())}) v({names})"


def _applied(spark, words: dict, function, names: tuple[str, str]):
    ship(spark)
    made = F.udf(function, "string")  # a few words
    return spark.createDataFrame([(w,) for w in words], f"{names[0]} string").select(names[0], made(names[0]).alias(names[1]))


for _code, _pairs in STEMS.items():

    def _stems(spark, sf, code=_code, pairs=_pairs):
        return _applied(spark, pairs, ANALYZERS[code].stem, ("token", "stem"))

    query(_values(_pairs, "token, stem"), f"stem_published_{_code}")(_stems)


@query(_values(KOELNER, "token, code"))
def koelner_published(spark, sf):
    return _applied(spark, KOELNER, ANALYZERS["de"].encode, ("token", "code"))


@query(_values(DOUBLE_METAPHONE, "token, code"))
def double_metaphone_published(spark, sf):
    return _applied(spark, DOUBLE_METAPHONE, ANALYZERS["en"].encode, ("token", "code"))


@query(_values(SENTENCES, "sentence, language"))
def detect_published(spark, sf):
    return _applied(spark, SENTENCES, detect, ("sentence", "language"))
