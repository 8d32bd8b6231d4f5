"""Russian."""

from lexwell.functions.stemmers import after_vowel_consonant, longest

V = "аеиоуыэюя"
# Fixed values of the algorithm; those of the first group stand after а or я.
GERUND1, GERUND2 = ("в", "вши", "вшись"), ("ив", "ивши", "ившись", "ыв", "ывши", "ывшись")
ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split()
PARTICIPLE1, PARTICIPLE2 = ("ем", "нн", "вш", "ющ", "щ"), ("ивш", "ывш", "ующ")
VERB1 = "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split()
VERB2 = "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split()
NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split()


def _grouped(w: str, rv: int, first, second) -> str | None:
    s = longest(w, (*first, *second), rv)
    if s is None or s not in second and w[len(w) - len(s) - 1 : len(w) - len(s)] not in ("а", "я"):
        return None
    if s not in second and len(w) - len(s) - 1 < rv:
        return None
    return w[: -len(s)]


def stem(word: str) -> str:
    w = word.replace("ё", "е")
    rv = next((i + 1 for i, c in enumerate(w) if c in V), len(w))
    r2 = after_vowel_consonant(w, V, after_vowel_consonant(w, V))
    done = _grouped(w, rv, GERUND1, GERUND2)
    if done is not None:
        w = done
    else:
        if s := longest(w, ("ся", "сь"), rv):
            w = w[: -len(s)]
        if s := longest(w, ADJECTIVE, rv):
            w = w[: -len(s)]
            p = _grouped(w, rv, PARTICIPLE1, PARTICIPLE2)
            w = w if p is None else p
        elif (v := _grouped(w, rv, VERB1, VERB2)) is not None:
            w = v
        elif s := longest(w, NOUN, rv):
            w = w[: -len(s)]
    if w.endswith("и") and len(w) - 1 >= rv:
        w = w[:-1]
    if s := longest(w, ("ост", "ость"), max(r2, rv)):
        w = w[: -len(s)]
    if s := longest(w, ("ейш", "ейше"), rv):
        w = w[: -len(s)]
        return w[:-1] if w.endswith("нн") and len(w) - 1 >= rv else w
    if w.endswith("нн") and len(w) - 2 >= rv:
        return w[:-1]
    return w[:-1] if w.endswith("ь") and len(w) - 1 >= rv else w
