"""The corpus as tables. Schemas are explicit and closed; nothing is inferred."""

VERSES = "translation string, bcv string, book string, chapter int, verse int, text string, note string"
SERVED = VERSES + ", sequence long"
CHAPTER_LINES = "translation string, kind string, book string, chapter int, text string"
INTERPOLATIONS = "translation string, after_bcv string, text string"
BOOKS = "translation string, pos int, book string"
LEDGER = "translation string, bucket string, marker string, chars long"
SOURCES = "translation string, path string, format string, source_chars long"
NOTES = "translation string, bcv string, note int, raw string, lemma string, readings array<string>, range string"
#: What one source file says, in one row: files are parsed in parallel, then spread into the tables.
DOCUMENT = (
    "path string, format string, error string, source_chars long, books array<string>, "
    "verses array<struct<book:string,chapter:int,verse:int,text:string,note:string>>, "
    "lines array<struct<kind:string,key:string,text:string>>, "
    "ledger array<struct<bucket:string,marker:string,chars:long>>"
)
EXPECTED_BOOKS = "book string, pos int, chapters int, verses long"
FAILURES = "check string, key string, expected string, actual string"
#: How the outcomes of foreign services are compared.
OUTCOMES = "adapter string, request string, status int, transport_error string, raw string, verses array<struct<book:string,chapter:int,verse:int,text:string>>"
ADAPTERS = "adapter string, edition string, carries_markup boolean, capabilities array<string>"
CELLS = "adapter string, probe string, dimension string, verdict string, summary string, request string, evidence string"
