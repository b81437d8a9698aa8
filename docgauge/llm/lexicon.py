"""Fixed word lists of the corpus languages and the spellings of language labels."""

from __future__ import annotations

LANGS = ("fr", "en", "de", "es", "it", "pt")

# Frequent grammatical words of each language.
FUNCTION_WORDS = {
    "fr": "le la les un une des du de et en est que qui dans pour par sur au aux avec ce cette ces son sa ses il elle on ne pas plus ou où si tant même sous après avant chaque lors dès depuis pendant selon sans afin lorsque car quoi l d qu n s c j".split(),
    "en": "the of and to in is that for with on as by at from or be are this an it not which after before during under within up than so if when once while every per no has been".split(),
    "de": "der die das den dem des ein eine einer eines und ist im in zu zum zur mit für auf bei nach von vor aus über an am wie wenn nicht auch damit bis unter gemäß sich durch als oder solange sofern keine wird".split(),
    "es": "el la los las un una de del y en que por para con según al se su lo como más tras sobre durante antes sin previa cada cuando aunque ante desde excepto no ha es".split(),
    "it": "il lo la i gli le un una di del della dei delle e in che per con al alla da dal dalla sul sulle si come non dopo prima entro presso ogni secondo fino perché anche quando salvo è così dell all".split(),
    "pt": "o a os as um uma de do da dos das e em que por para com no na nos nas ao à pelo pela se como não após antes até sobre segundo cada quando sem sob mesmo é".split(),
}

# Spellings by which a label names a language.
LABEL_NAMES = {
    "fr": "fr fra fre french français francais französisch francés frances francese francês".split(),
    "en": "en eng english anglais englisch inglés ingles inglese inglês".split(),
    "de": "de deu ger german deutsch allemand alemán aleman tedesco alemão".split(),
    "es": "es spa spanish español espanol castellano espagnol spanisch spagnolo espanhol".split(),
    "it": "it ita italian italiano italien italienisch".split(),
    "pt": "pt por portuguese português portugues portugais portugiesisch portugués portoghese".split(),
}

#: Words of any of the languages, for the share of common words.
COMMON = sorted({w for ws in FUNCTION_WORDS.values() for w in ws})
