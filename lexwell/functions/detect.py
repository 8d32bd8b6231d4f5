"""Language detection by rank order of character n-grams (Cavnar and Trenkle, 1994)."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

from lexwell.functions.stopwords import STOP_WORDS

# Own sentences; with the function words of each language they make its profile.
SEEDS = {
    "da": "Vi sender jer de nye papirer i morgen, når værkstedet har prøvet maskinen og skrevet alle målinger ned. Børnene cykler hjem fra skolen gennem den gamle by.",
    "de": "Wir schicken Ihnen morgen die neuen Unterlagen, sobald die Werkstatt die Maschine geprüft und alle Messwerte aufgeschrieben hat. Die Kinder fahren durch die alte Stadt nach Hause.",
    "en": "We will send you the new papers tomorrow, as soon as the workshop has tested the machine and written down all readings. The children are riding home from school through the old town.",
    "es": "Mañana les enviaremos los nuevos documentos, cuando el taller haya probado la máquina y anotado todas las medidas. Los niños vuelven a casa desde la escuela por la ciudad vieja.",
    "fi": "Lähetämme teille uudet paperit huomenna, kun korjaamo on kokeillut konetta ja kirjoittanut kaikki mittaukset muistiin. Lapset pyöräilevät koulusta kotiin vanhan kaupungin läpi.",
    "fr": "Nous vous enverrons demain les nouveaux documents, dès que l'atelier aura essayé la machine et noté toutes les mesures. Les enfants rentrent de l'école à vélo à travers la vieille ville.",
    "hu": "Holnap elküldjük önöknek az új iratokat, amint a műhely kipróbálta a gépet és minden mérést feljegyzett. A gyerekek az iskolából a régi városon át kerékpároznak haza.",
    "it": "Domani vi manderemo i nuovi documenti, appena l'officina avrà provato la macchina e scritto tutte le misure. I bambini tornano a casa dalla scuola in bicicletta attraverso la città vecchia.",
    "nl": "Morgen sturen wij u de nieuwe papieren, zodra de werkplaats de machine heeft getest en alle metingen heeft opgeschreven. De kinderen fietsen van school naar huis door de oude stad.",
    "no": "Vi sender dere de nye papirene i morgen, når verkstedet har prøvd maskinen og skrevet ned alle målingene. Barna sykler hjem fra skolen gjennom den gamle byen.",
    "pt": "Amanhã enviaremos os novos documentos, assim que a oficina tiver experimentado a máquina e anotado todas as medições. As crianças voltam da escola para casa de bicicleta pela cidade velha.",
    "ro": "Mâine vă vom trimite documentele noi, imediat ce atelierul a încercat mașina și a notat toate măsurătorile. Copiii se întorc acasă de la școală cu bicicleta prin orașul vechi.",
    "ru": "Завтра мы отправим вам новые документы, как только мастерская испытает машину и запишет все измерения. Дети едут из школы домой на велосипедах через старый город.",
    "sv": "Vi skickar er de nya papperen i morgon, så snart verkstaden har provat maskinen och skrivit upp alla mätningar. Barnen cyklar hem från skolan genom den gamla staden.",
    "tr": "Atölye makineyi denedikten ve bütün ölçümleri yazdıktan sonra yarın size yeni belgeleri göndereceğiz. Çocuklar okuldan eve eski şehrin içinden bisikletle dönüyorlar.",
}
MOST = 400


def ranked_grams(text: str, most: int = MOST) -> list[str]:
    """The most frequent n-grams of one to four letters, word ends marked; ties in alphabetical order."""
    counts: Counter[str] = Counter()
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        padded = f"_{word}_"
        for n in range(1, 5):
            counts.update(padded[i : i + n] for i in range(len(padded) - n + 1))
    counts.pop("_", None)
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:most]]


class RankOrderDetector:
    """Detects the language whose profile is nearest; a callable of one text, null for texts without letters."""

    def __init__(self, texts: dict[str, str], most: int = MOST) -> None:
        self.most = most
        self.profiles = {language: {g: i for i, g in enumerate(ranked_grams(text, most))} for language, text in texts.items()}

    def __call__(self, text: str | None) -> str | None:
        grams = ranked_grams(text or "", self.most)
        if not grams or not self.profiles:
            return None
        return min(self.profiles, key=lambda language: (self._distance(grams, self.profiles[language]), language))

    def _distance(self, grams: list[str], profile: dict[str, int]) -> int:
        return sum(min(abs(profile.get(g, 2 * self.most) - i), self.most) for i, g in enumerate(grams))


@lru_cache(maxsize=1)
def default_detector() -> RankOrderDetector:
    return RankOrderDetector({language: f"{seed} {seed} {' '.join(sorted(STOP_WORDS[language]))}" for language, seed in SEEDS.items()})


def detect(text: str | None) -> str | None:
    """The language of a text by the built-in profiles."""
    return default_detector()(text)
