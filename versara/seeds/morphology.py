"""Irregular forms and refused merges of the English families. Fixed values."""

#: lemma: its irregular forms
IRREGULAR = """
say: said saith sayest saidst
speak: spake spoken speaketh speakest
tell: told telleth
be: was were wast wert been art are is being
have: hath hast had hadst
do: doeth doth dost did didst done doest doing doings
lie: lying lay lain lieth
go: went gone goeth goest
come: came cometh comest
bring: brought bringeth
send: sent sendeth
fall: fell fallen falleth
rise: rose risen riseth
stand: stood standeth
sit: sat sitteth
know: knew known knoweth knowest
see: saw seen seeth seest sawest
hear: heard heareth hearest
find: found findeth
think: thought thinketh
give: gave given giveth givest
take: took taken taketh takest
make: made maketh makest
write: wrote written writeth
beget: begat begotten
smite: smote smitten smiteth
slay: slew slain slayeth
eat: ate eaten eateth
drink: drank drunk drinketh
build: built buildeth
dwell: dwelt dwelleth
bear: bare borne beareth
become: became becometh
begin: began begun beginneth
keep: kept keepeth
leave: left leaveth
cast: casteth
shall: shalt
will: wilt
would: wouldest
could: couldest
man: men
woman: women
child: children
brother: brethren
foot: feet
tooth: teeth
ox: oxen
mouse: mice
"""
LEMMA_OF = {form: line.split(":")[0] for line in IRREGULAR.split("\n") if line for form in line.split(": ")[1].split()}

#: Merges that the suffix rules would make wrongly: form>root.
REFUSED = frozenset(
    """
seed>see bed>be deed>dee need>nee heed>hee reed>ree creed>cree weed>wee feed>fee breed>bree steed>stee
wicked>wick sacred>sacr blessed>bless aged>age hundred>hundr
red>re led>le fed>fe wed>we shed>she bred>bre
goodly>good godly>god holy>hol
founded>found felled>fell lied>lie lies>lie hades>hade hasted>hast wasted>wast
""".split()
)
