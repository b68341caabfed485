"""Language of a text by letter n-grams (Dunning 1994): the one whose n-grams make its words likeliest; by script where that is
enough."""

from __future__ import annotations

import re
from collections import Counter
from functools import cache, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Articles 1 to 3 of the Universal Declaration of Human Rights, shortened, and frequent small words.
SAMPLES = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. Everyone is entitled to all the rights and freedoms set forth in this declaration, without distinction of any kind, such as race, colour, sex, language, religion, political or other opinion. Everyone has the right to life, liberty and security of person. "
    "the of and to in is that for it on was with as be by at from this have not are but had his they which she you were her there been their will would when who more no if out so said what about than into them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geiste der Brüderlichkeit begegnen. Jeder hat Anspruch auf alle in dieser Erklärung verkündeten Rechte und Freiheiten ohne irgendeinen Unterschied, etwa nach Rasse, Hautfarbe, Geschlecht, Sprache, Religion, politischer oder sonstiger Anschauung. Jeder hat das Recht auf Leben, Freiheit und Sicherheit der Person. "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei hatte kann gegen vom können schon wenn habe seine ihre dann unter wir soll ich eines jahr zwei diese dieser wieder keine seiner",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. Chacun peut se prévaloir de tous les droits et de toutes les libertés proclamés dans la présente déclaration, sans distinction aucune, notamment de race, de couleur, de sexe, de langue, de religion, d'opinion politique ou de toute autre opinion. Tout individu a droit à la vie, à la liberté et à la sûreté de sa personne. "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ils son mais comme ou on si leur y dont tout nous sa cette aux être fait elle même ces ses deux ans encore aussi peut après sans autre très bien où entre ont été était avait",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. Toda persona tiene todos los derechos y libertades proclamados en esta declaración, sin distinción alguna de raza, color, sexo, idioma, religión, opinión política o de cualquier otra índole. Todo individuo tiene derecho a la vida, a la libertad y a la seguridad de su persona. "
    "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede todos así nos ni parte tiene él uno donde bien tiempo mismo ese ahora",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. Ad ogni individuo spettano tutti i diritti e tutte le libertà enunciate nella presente dichiarazione, senza distinzione alcuna, per ragioni di razza, di colore, di sesso, di lingua, di religione, di opinione politica o di altro genere. Ogni individuo ha diritto alla vita, alla libertà ed alla sicurezza della propria persona. "
    "di e il la che in a per un è del non una si con della i da le al sono dei come nel più alla lo gli anche ha o ma delle se nella su dal ad essere tra anni questo cui ed due ai era stato fatto loro suo prima quando molto solo dopo ancora tutto perché sua ci hanno già così",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade. Todos os seres humanos podem invocar os direitos e as liberdades proclamados na presente declaração, sem distinção alguma, nomeadamente de raça, de cor, de sexo, de língua, de religião, de opinião política ou outra. Todo o indivíduo tem direito à vida, à liberdade e à segurança pessoal. "
    "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até isso ela entre era depois sem mesmo aos ter seus quem nas me esse eles estão você tinha foram essa num nem",
    "nl": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen. Een ieder heeft aanspraak op alle rechten en vrijheden, in deze verklaring opgesomd, zonder enig onderscheid van welke aard ook, zoals ras, kleur, geslacht, taal, godsdienst, politieke of andere overtuiging. Een ieder heeft het recht op leven, vrijheid en onschendbaarheid van zijn persoon. "
    "de van een en het in is dat op te zijn met voor niet aan er om ook als dan maar bij uit nog door over naar hij ze wat zo kan of wordt heeft deze worden meer werd geen hebben was tot we al je haar die men onder veel zou nu moet zich ons zij wij toen",
    "sv": "Alla människor är födda fria och lika i värde och rättigheter. De är utrustade med förnuft och samvete och bör handla gentemot varandra i en anda av broderskap. Var och en är berättigad till alla de rättigheter och friheter som uttalas i denna förklaring utan åtskillnad av något slag, såsom ras, hudfärg, kön, språk, religion, politisk eller annan uppfattning. Var och en har rätt till liv, frihet och personlig säkerhet. "
    "och i att det som en på är av för med till den har de inte om ett han men var jag sig från vi så kan när år under också efter eller nu sin där vid mot ska skulle kommer ut får finns vara hade alla andra mycket än här då sedan över bara in blir upp även vad få två vill ha många hon mer",
}
#: Scripts that one language nearly alone uses.
SCRIPTS = (("ja", "\u3040-\u30ff"), ("ko", "\uac00-\ud7af\u1100-\u11ff"), ("zh", "\u4e00-\u9fff"), ("ru", "\u0400-\u04ff"), ("ar", "\u0600-\u06ff"), ("he", "\u0590-\u05ff"), ("el", "\u0370-\u03ff"), ("hi", "\u0900-\u097f"), ("th", "\u0e00-\u0e7f"))
SCRIPT = [(k, re.compile(f"[{r}]")) for k, r in SCRIPTS]
LETTERS = re.compile(r"[^\W\d_]+")
SMOOTH, ORDERS = 0.05, (1, 2, 3, 4)
CODES = sorted(SAMPLES)


def grams(word: str) -> list[str]:
    """The 1- to 4-grams of a word, padded by a blank on either side."""
    w = f" {word} "
    return [g for n in ORDERS for i in range(len(w) - n + 1) if (g := w[i : i + n]) != " "]


@cache
def model() -> tuple[dict[str, np.ndarray], dict[int, np.ndarray]]:
    """(log probability of each known n-gram by language, and of an unknown one by its length)."""
    counts = {k: Counter(g for w in LETTERS.findall(SAMPLES[k].lower()) for g in grams(w)) for k in CODES}
    known = sorted({g for c in counts.values() for g in c})
    total = {n: np.array([sum(c for g, c in counts[k].items() if len(g) == n) for k in CODES], float) for n in ORDERS}
    size = {n: 1 + sum(len(g) == n for g in known) for n in ORDERS}
    at = lambda n, c: np.log((c + SMOOTH) / (total[n] + SMOOTH * size[n]))
    return {g: at(len(g), np.array([counts[k][g] for k in CODES], float)) for g in known}, {n: at(n, 0.0) for n in ORDERS}


@lru_cache(maxsize=200_000)
def word_score(word: str) -> np.ndarray:
    known, unknown = model()
    return np.sum([known[g] if g in known else unknown[len(g)] for g in grams(word)], axis=0)


def language_of(text: str | None) -> str | None:
    """A language's code; None for under three characters or no letters."""
    text = (text or "").strip()
    words = Counter(LETTERS.findall(text.lower()))
    letters = sum(len(w) * n for w, n in words.items())
    if len(text) < 3 or not letters:
        return None
    for code, pattern in SCRIPT:
        if 3 * len(pattern.findall(text)) >= letters:
            return code
    scores = np.array(list(words.values()), float) @ np.stack([word_score(w) for w in words])
    return CODES[int(np.argmax(scores))]


@F.pandas_udf(T.StringType())
def detect_language(text: pd.Series) -> pd.Series:
    return text.map(language_of)
