"""Romanian."""

from lexwell.functions.stemmers import after_vowel_consonant, longest, marked_between_vowels, romance_rv

V = "aeiouâîă"
# Fixed values of the algorithm.
STEP0 = {
    "ul": "", "ului": "", "aua": "a", **dict.fromkeys("ea ele elor".split(), "e"),
    **dict.fromkeys("ii iua iei iile iilor ilor".split(), "i"), "ile": "i", "atei": "at", "ație": "ați", "ația": "ați",
}
COMBO = {
    "abil": "abilitate abilitati abilităi abilități", "ibil": "ibilitate", "iv": "ivitate ivitati ivităi ivități", "ic": "icitate icitati icităi icități icator icatori "
    "iciv iciva icive icivi icivă ical icala icale icali icală", "at": "ativ ativa ative ativi ativă ațiune atoare ator atori ătoare ător ători", "it": "itiv itiva itive "
    "itivi itivă ițiune itoare itor itori",
}
COMBINED = {s: to for to, listed in COMBO.items() for s in listed.split()}
DELETED = (
    "at ata ată ati ate ut uta ută uti ute it ita ită iti ite ic ica ice ici ică abil abila abile abili abilă ibil ibila ibile ibili ibilă oasa oasă oase os osi oși "
    "ant anta ante anti antă ator atori itate itati ităi ități iv iva ive ivi ivă"
).split()
IST = "ism isme ist ista iste isti istă iști".split()
VERBS_ANY = "am ași ați ă ez eze ezi ează em eam eai ea eați eau est ește ești ăm ăsc ăști ăște esc im iți sem seși se seți ser".split()
VERBS = (
    "are ere ire âre ind ând indu ându eze ească ez ezi ează esc ești ește ăsc ăști ăște am ai au eam eai ea eați eau iam iai ia iați iau ui ași arăm arăți ară uși urăm "
    "urăți ură iși irăm irăți iră âi âși ârăm ârăți âră asem aseși ase aserăm aserăți aseră isem iseși ise iserăm iserăți iseră âsem âseși âse âserăm âserăți âseră "
    "usem useși use userăm userăți useră"
).split()
VERBS_FREE = "ăm ați em eți im iți âm âți seși serăm serăți seră sei se sesem seseși sese seserăm seserăți seseră".split()


def stem(word: str) -> str:
    if not word:
        return word
    w = marked_between_vowels(word.replace("ş", "ș").replace("ţ", "ț"), "ui", V)
    rv = romance_rv(w, V)
    r1 = after_vowel_consonant(w, V)
    r2 = after_vowel_consonant(w, V, r1)
    s = longest(w, STEP0)
    if s and len(w) - len(s) >= r1 and not (s == "ile" and w[:-3].endswith("ab")):
        w = w[: -len(s)] + STEP0[s]
    removed = False
    while (s := longest(w, COMBINED)) and len(w) - len(s) >= r1:
        w, removed = w[: -len(s)] + COMBINED[s], True
    s = longest(w, (*DELETED, *IST, "iune", "iuni"))
    if s and len(w) - len(s) >= r2:
        before = w[: -len(s)]
        if s in ("iune", "iuni"):
            if before.endswith("ț"):
                w, removed = before[:-1] + "t", True
        else:
            w, removed = before + ("ist" if s in IST else ""), True
    if not removed:
        s = longest(w, (*VERBS, *VERBS_FREE), rv)
        if s:
            before = w[: -len(s)]
            if s in VERBS_FREE or len(before) - 1 >= rv and (before[-1] not in V or before[-1] == "u"):
                w = before
    s = longest(w, ("a", "e", "i", "ie", "ă"), rv)
    return (w[: -len(s)] if s else w).lower()
