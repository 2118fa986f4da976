"""Roles of elements, markers and styles in the source formats. Fixed values, in groups by role.

text: part of what surrounds it. para: the same, and a break. note: a footnote's text. label: what introduces
a note, not kept. skip: never kept. meta: headings, identification and the like, not kept. mark: structure.
"""

USFX = """
mark usfx book c v ve d b
text w q p add qs sc it bd bdit em no ord sup pn k tl bk sls qt nd wj
note f ft fqa fq
label fr fk fv fl
skip x xo xt xk xq
meta id ide h toc rem languageCode cl cp ca va vp periph generated s ms mt fig ndx
"""

USFM = """
mark c v d
para p m nb b q q1 q2 q3 q4 qr pi pi1 pi2 pc pm po li li1 li2 cls ib
text w add qs sc it bd bdit em no nd wj tl bk pn qt sls ord sup xo xt xk
note f ft fq fqa
label fr fk fv fl
skip va vp x fig
meta id h toc toc1 toc2 toc3 toca1 toca2 toca3 qc mt mt1 mt2 mt3 mt4 ms ms1 ms2 mr sr r s s1 s2 s3 is is1 is2
meta ip im iot io io1 io2 ie imt imt1 ide rem sts cl cp ca periph ndx
"""

USX = """
mark c v
text add addpn bd bdit bk ca dc efm em fm it jmp k lik litl liv liv1 liv2 liv3 liv4 liv5 nd ndx no ord pn png pro qac qs
text qt rb rq sc sig sls sup tl va vp w wa wg wh wj
para b cls lf lh li li1 li2 li3 li4 lim lim1 lim2 lim3 lim4 m mi nb p p1 p2 pb pc ph ph1 ph2 ph3 pi pi1 pi2 pi3 pm pmc
para pmo pmr po pr q q1 q2 q3 q4 qd qm qm1 qm2 qm3 qr tr
note cat ef f fdc fe fk fl fp fq fqa fr ft fv fw
meta cd cl cp d esb ex h h1 h2 h3 ib id ide ie iex ili ili1 ili2 im imi imq imt imt1 imt2 imt3 imt4 imte imte1 imte2 io
meta io1 io2 io3 io4 ior iot ip ipi ipq ipr iq iq1 iq2 iq3 iqt is is1 is2 k1 k2 lit mr ms ms1 ms2 ms3 mt mt1 mt2 mt3 mt4
meta mte mte1 mte2 qa qc r rem restore s s1 s2 s3 s4 sd sd1 sd2 sd3 sd4 sp sr toc1 toc2 toc3 toca1 toca2 toca3 ts usfm x
meta xdc xk xnt xo xop xot xq xt xta
"""

#: Elements of the style-based format; those in the second row are looked through.
USX_ELEMENTS = frozenset("book chapter verse para char note row sidebar figure".split())
USX_THROUGH = frozenset("usx optbreak ms ref table cell periph".split())

#: Ids and names of the Greek text's books, in the order of its canon.
GREEK_BOOKS = """
Mt Matthew MAT
Mk Mark MRK
Lu Luke LUK
Jn John JHN
Ac Acts ACT
Ro Romans ROM
1Co 1_Corinthians 1CO
2Co 2_Corinthians 2CO
Gal Galatians GAL
Eph Ephesians EPH
Php Philippians PHP
Col Colossians COL
1Th 1_Thessalonians 1TH
2Th 2_Thessalonians 2TH
1Tim 1_Timothy 1TI
2Tim 2_Timothy 2TI
Tit Titus TIT
Phm Philemon PHM
Heb Hebrews HEB
Jam James JAS
1Pe 1_Peter 1PE
2Pe 2_Peter 2PE
1Jn 1_John 1JN
2Jn 2_John 2JN
3Jn 3_John 3JN
Jud Jude JUD
Re Revelation REV
"""


def roles(text: str) -> dict[str, str]:
    """Name to role."""
    out = {}
    for line in text.split("\n"):
        role, *names = line.split() or [""]
        out |= dict.fromkeys(names, role)
    return out


GREEK_ID, GREEK_NAME = ({(r := line.split())[k].replace("_", " "): r[2] for line in GREEK_BOOKS.split("\n") if line} for k in (0, 1))
GREEK_ORDER = list(GREEK_ID.values())
