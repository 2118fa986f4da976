"""Books, traditions and editions. Fixed values, in their natural order."""

#: id, name, testament, author, date, genre
BOOKS = """
GEN|Genesis|OT|Moses|c. 1400-400 BC|Law
EXO|Exodus|OT|Moses|c. 1400-400 BC|Law
LEV|Leviticus|OT|Moses|c. 1400-400 BC|Law
NUM|Numbers|OT|Moses|c. 1400-400 BC|Law
DEU|Deuteronomy|OT|Moses|c. 1400-400 BC|Law
JOS|Joshua|OT|Joshua|c. 1200-550 BC|History
JDG|Judges|OT|Samuel|c. 1050-550 BC|History
RUT|Ruth|OT|Samuel|c. 1000-450 BC|History
1SA|1 Samuel|OT|Samuel, Nathan, and Gad|c. 1000-550 BC|History
2SA|2 Samuel|OT|Samuel, Nathan, and Gad|c. 1000-550 BC|History
1KI|1 Kings|OT|Jeremiah|c. 600-550 BC|History
2KI|2 Kings|OT|Jeremiah|c. 600-550 BC|History
1CH|1 Chronicles|OT|Ezra|c. 450-400 BC|History
2CH|2 Chronicles|OT|Ezra|c. 450-400 BC|History
EZR|Ezra|OT|Ezra|c. 450-400 BC|History
NEH|Nehemiah|OT|Nehemiah|c. 430-400 BC|History
EST|Esther|OT|Mordecai|c. 470-350 BC|History
JOB|Job|OT|Unknown|c. 2000-500 BC|Wisdom
PSA|Psalms|OT|David and others|c. 1000-400 BC|Poetry
PRO|Proverbs|OT|Solomon and others|c. 950-700 BC|Wisdom
ECC|Ecclesiastes|OT|Solomon|c. 950-200 BC|Wisdom
SNG|Song of Solomon|OT|Solomon|c. 950-400 BC|Poetry
ISA|Isaiah|OT|Isaiah|c. 740-680 BC|Major Prophets
JER|Jeremiah|OT|Jeremiah|c. 626-580 BC|Major Prophets
LAM|Lamentations|OT|Jeremiah|c. 586-570 BC|Major Prophets
EZK|Ezekiel|OT|Ezekiel|c. 593-570 BC|Major Prophets
DAN|Daniel|OT|Daniel|c. 605-165 BC|Major Prophets
HOS|Hosea|OT|Hosea|c. 750-715 BC|Minor Prophets
JOL|Joel|OT|Joel|c. 835-400 BC|Minor Prophets
AMO|Amos|OT|Amos|c. 760-750 BC|Minor Prophets
OBA|Obadiah|OT|Obadiah|c. 850-586 BC|Minor Prophets
JON|Jonah|OT|Jonah|c. 780-400 BC|Minor Prophets
MIC|Micah|OT|Micah|c. 735-700 BC|Minor Prophets
NAM|Nahum|OT|Nahum|c. 663-612 BC|Minor Prophets
HAB|Habakkuk|OT|Habakkuk|c. 640-600 BC|Minor Prophets
ZEP|Zephaniah|OT|Zephaniah|c. 640-609 BC|Minor Prophets
HAG|Haggai|OT|Haggai|c. 520 BC|Minor Prophets
ZEC|Zechariah|OT|Zechariah|c. 520-480 BC|Minor Prophets
MAL|Malachi|OT|Malachi|c. 430-400 BC|Minor Prophets
MAT|Matthew|NT|Matthew|c. AD 60-90|Gospel
MRK|Mark|NT|John Mark|c. AD 55-70|Gospel
LUK|Luke|NT|Luke|c. AD 60-85|Gospel
JHN|John|NT|John the Apostle|c. AD 85-95|Gospel
ACT|Acts|NT|Luke|c. AD 62-90|History
ROM|Romans|NT|Paul|c. AD 57|Epistle
1CO|1 Corinthians|NT|Paul|c. AD 55|Epistle
2CO|2 Corinthians|NT|Paul|c. AD 56|Epistle
GAL|Galatians|NT|Paul|c. AD 49-55|Epistle
EPH|Ephesians|NT|Paul|c. AD 60-62|Epistle
PHP|Philippians|NT|Paul|c. AD 60-62|Epistle
COL|Colossians|NT|Paul|c. AD 60-62|Epistle
1TH|1 Thessalonians|NT|Paul|c. AD 50-51|Epistle
2TH|2 Thessalonians|NT|Paul|c. AD 50-52|Epistle
1TI|1 Timothy|NT|Paul|c. AD 62-64|Epistle
2TI|2 Timothy|NT|Paul|c. AD 64-67|Epistle
TIT|Titus|NT|Paul|c. AD 62-64|Epistle
PHM|Philemon|NT|Paul|c. AD 60-62|Epistle
HEB|Hebrews|NT|Unknown|c. AD 60-90|Epistle
JAS|James|NT|James, brother of Jesus|c. AD 45-62|Epistle
1PE|1 Peter|NT|Peter|c. AD 60-65|Epistle
2PE|2 Peter|NT|Peter|c. AD 65-68|Epistle
1JN|1 John|NT|John the Apostle|c. AD 85-95|Epistle
2JN|2 John|NT|John the Apostle|c. AD 85-95|Epistle
3JN|3 John|NT|John the Apostle|c. AD 85-95|Epistle
JUD|Jude|NT|Jude, brother of Jesus|c. AD 65-80|Epistle
REV|Revelation|NT|John|c. AD 68-95|Apocalyptic
"""

DEUTEROCANON = """
TOB|Tobit|OT|Unknown|c. 225-175 BC|History
JDT|Judith|OT|Unknown|c. 150-100 BC|History
WIS|Wisdom of Solomon|OT|Unknown|c. 100-50 BC|Wisdom
SIR|Sirach|OT|Jesus ben Sira|c. 200-175 BC|Wisdom
BAR|Baruch|OT|Baruch|c. 200-100 BC|Major Prophets
1MA|1 Maccabees|OT|Unknown|c. 100 BC|History
2MA|2 Maccabees|OT|Unknown|c. 124-100 BC|History
1ES|1 Esdras|OT|Unknown|c. 200-100 BC|History
3MA|3 Maccabees|OT|Unknown|c. 100-1 BC|History
MAN|Prayer of Manasseh|OT|Unknown|c. 200-1 BC|Poetry
"""

#: Old Testament of the Vulgate tradition, and of the Greek one.
CATHOLIC_OT = """
GEN EXO LEV NUM DEU JOS JDG RUT 1SA 2SA 1KI 2KI 1CH 2CH EZR NEH TOB JDT EST 1MA 2MA JOB PSA PRO ECC SNG WIS SIR
ISA JER LAM BAR EZK DAN HOS JOL AMO OBA JON MIC NAM HAB ZEP HAG ZEC MAL
"""
ORTHODOX_OT = """
GEN EXO LEV NUM DEU JOS JDG RUT 1SA 2SA 1KI 2KI 1CH 2CH 1ES EZR NEH EST JDT TOB 1MA 2MA 3MA PSA MAN PRO ECC SNG JOB
WIS SIR HOS AMO MIC JOL OBA JON NAM HAB ZEP HAG ZEC MAL ISA JER BAR LAM EZK DAN
"""
#: What the Latin edition prints between the testaments.
PRINTED_AFTER_OT = "TOB JDT WIS SIR BAR 1MA 2MA"


def _rows(text: str) -> list[list[str]]:
    return [line.split("|") for line in text.split("\n") if line]


BOOK_ROWS = [(*r, False) for r in _rows(BOOKS)] + [(*r, True) for r in _rows(DEUTEROCANON)]
BOOK_SCHEMA = "id string, name string, testament string, author string, approximate_date string, genre string, is_deuterocanon boolean"
NAMES = {r[0]: r[1] for r in BOOK_ROWS}
_OT, _NT = ([r[0] for r in _rows(BOOKS) if r[2] == t] for t in ("OT", "NT"))

#: How a tradition enumerates its canon; and, never to be merged with it, how an edition prints its books.
TRADITIONS = {"protestant": _OT + _NT, "catholic": CATHOLIC_OT.split() + _NT, "orthodox_greek": ORTHODOX_OT.split() + _NT}
EDITION_ORDER = {"asv": _OT + _NT, "dra": _OT + PRINTED_AFTER_OT.split() + _NT, "sblgnt": _NT}

EDITION_SCHEMA = "id string, name string, language string, searchable boolean, has_notes boolean, psalm_schemes array<string>, default_edition boolean"
EDITIONS = [
    ("asv", "American Standard Version", "en", True, False, ["hebrew", "greek"], True),
    ("dra", "Douay-Rheims American Edition", "en", True, False, ["greek"], False),
    ("sblgnt", "SBL Greek New Testament", "grc", False, True, [], False),
]

#: Books that hold no text of the corpus.
NON_SCRIPTURE = frozenset("FRT INT BAK CNC GLO TDX NDX OTH".split())

#: Conventional abbreviations; they win over prefixes of names.
ALIASES = """
GEN gen,gn,ge
EXO ex,exo,exod
LEV lev,lv
NUM num,nm,nu
DEU deut,deu,dt
JOS josh,jos
JDG judg,jdg,jg
RUT ruth,rut,ru
1SA 1 sam,1 sa,1 sm
2SA 2 sam,2 sa,2 sm
1KI 1 kgs,1 ki,1 kin,1 kings
2KI 2 kgs,2 ki,2 kin,2 kings
1CH 1 chr,1 ch,1 chron
2CH 2 chr,2 ch,2 chron
EZR ezr
NEH neh,ne
EST esth,est
JOB jb
PSA ps,psa,psalm,psalms,pss
PRO prov,pro,pr,prv
ECC eccl,ecc,qoh
SNG song,sng,sos,canticles,song of songs,song of solomon
ISA isa,is
JER jer,jr
LAM lam
EZK ezek,ezk,eze
DAN dan,dn
HOS hos
JOL joel,jol
AMO amos,amo,am
OBA obad,oba,ob
JON jonah,jon
MIC mic,mi
NAM nah,nam
HAB hab
ZEP zeph,zep
HAG hag,hg
ZEC zech,zec
MAL mal
MAT matt,mat,mt
MRK mark,mrk,mk
LUK luke,luk,lk
JHN john,jhn,jn
ACT acts,act
ROM rom,rm
1CO 1 cor,1 co
2CO 2 cor,2 co
GAL gal,ga
EPH eph
PHP phil,php,phi
COL col
1TH 1 thess,1 th,1 thes
2TH 2 thess,2 th,2 thes
1TI 1 tim,1 ti,1 tm
2TI 2 tim,2 ti,2 tm
TIT titus,tit
PHM phlm,phm,philem,philemon
HEB heb
JAS jas,jm,james
1PE 1 pet,1 pe,1 pt
2PE 2 pet,2 pe,2 pt
1JN 1 john,1 jn,1 jhn
2JN 2 john,2 jn,2 jhn
3JN 3 john,3 jn,3 jhn
JUD jude,jud
REV rev,rv,apocalypse
TOB tob,tb
JDT jdt,jdth,jth
WIS wis,ws
SIR sir,ecclesiasticus,ecclus
BAR bar,br
1MA 1 maccabees,1 macc,1 mac,1 ma
2MA 2 maccabees,2 macc,2 mac,2 ma
"""
ALIAS_OF = {alias: line[:3] for line in ALIASES.split("\n") if line for alias in line[4:].split(",")}
#: Words and numerals that open a numbered book's name.
ORDINALS = {"first": "1", "second": "2", "third": "3", "i": "1", "ii": "2", "iii": "3"}
