"""Word lists, lookup tables and patterns that define the results."""

# Words, codes and limits that results depend on.

STOP_WORDS = (
    "a an the and or but of to in on at by for with from as is are was were be been being it its this that these those "
    "my me i we our you your he she his her they their them what which who whom where when how do does did about say says "
    "any all some no not can will would should into than then there so if up out has have had find show get "
    "le la les de des et un une du"
).split()

LANGUAGE_MARKERS = {
    "eng": "the and of to is in that it was with for this".split(),
    "fre": "le la les et des est une dans que pour pas sur".split(),
    "spa": "el los las y es una que por para con del como".split(),
    "ger": "der die das und ist nicht mit ein eine auf für dem".split(),
    "por": "os as não uma com para que em dos das mais ao".split(),
}
LANGUAGE_CODES = {
    "eng": "en eng english", "fre": "fr fra fre french", "spa": "es spa spanish", "ger": "de deu ger german", "por": "pt por portuguese",
    "twi": "tw twi", "aka": "ak aka", "ewe": "ee ewe", "hau": "ha hau", "yor": "yo yor", "swa": "sw swa",
}

SMALL_WORDS = "a an the of and or in on at to for by".split()

TYPE_WORDS = {
    "video": "video videos film films clip clips movie",
    "image": "photo photos picture pictures image images pics",
    "audio": "audio recording recordings podcast podcasts",
    "book": "book books ebook ebooks",
    "document": "pdf pdfs document documents docs scan scans",
}
MEDIA_TYPES = ("book", "document", "image", "video", "audio", "other")
MEDIA_LABELS = {"book": "Book", "document": "Document", "image": "Image", "video": "Video", "audio": "Audio", "other": "Other"}
DCMI_TYPES = {"book": "Text", "document": "Text", "image": "StillImage", "video": "MovingImage", "audio": "Sound", "other": "Dataset"}
MODULES = {"book": "Books", "document": "Documents", "image": "Photos", "video": "Videos", "audio": "Audio", "other": "Documents"}
EXTENSIONS = {
    "book": "epub mobi azw3 fb2",
    "image": "jpg jpeg png gif webp heic heif tif tiff bmp",
    "video": "mp4 mov mkv avi webm 3gp m4v",
    "audio": "mp3 m4a aac wav ogg oga flac opus amr",
}
MIME_TYPES = {
    "epub": "application/epub+zip", "pdf": "application/pdf", "txt": "text/plain", "md": "text/markdown", "html": "text/html", "htm": "text/html",
    "csv": "text/csv", "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "heic": "image/heic",
    "mp4": "video/mp4", "mov": "video/quicktime", "webm": "video/webm", "mkv": "video/x-matroska", "mp3": "audio/mpeg", "m4a": "audio/mp4",
    "wav": "audio/wav", "ogg": "audio/ogg", "flac": "audio/flac",
}

DC_ELEMENTS = (
    "title creator subject description publisher contributor date type format identifier source language relation coverage rights"
).split()
DC_CORE = "title creator subject date type format identifier language".split()

ORGANISATION = (
    r"(?i)(?<![A-Za-z0-9_])(?:Ltd|Limited|Inc|Company|Co\.|Commission|Authority|University|Ministry|Association|Bank|Press|Publishers?|"
    r"Corporation|Council|Service|Church|School|Hospital|Institute|Agency|Foundation|Family)(?![A-Za-z0-9_])"
)

#: Groups of related words; a group's number is its place.
CONCEPTS = [
    x.split()
    for x in (
        "lease tenancy rental rent landlord tenant letting", "notice termination terminate quit vacate", "video film recording clip footage",
        "photo picture image snapshot photograph", "grandma grandmother nana granny grandparent", "grandpa grandfather",
        "wedding marriage bride groom", "naming outdooring christening baptism", "lecture class lesson course seminar tutorial",
        "invoice bill receipt payment statement", "electricity power ecg utility prepaid",
        "doctor medical hospital clinic health prescription medicine", "car vehicle auto motor",
        "recipe cooking dish meal food cook jollof", "contract agreement deal terms", "money finance bank savings loan account",
        "school education university college student", "song music track album highlife", "book novel ebook fiction",
        "child kid children baby son daughter", "house home flat apartment property land plot",
        "job work employment career cv resume salary", "travel trip journey holiday vacation flight", "insurance policy cover premium",
        "algorithm programming code software data computer", "farm farming crop cocoa harvest agriculture", "tax gra revenue vat",
        "passport visa id identity certificate birth",
    )
]

#: Class number, label and keywords.
CLASSES = [
    ("005", "Computer programming, programs, data", "programming, software, algorithm, data structures, computer, code, database, flutter, python, java, hash table, compiler"),
    ("020", "Library and information sciences", "library, cataloguing, cataloging, metadata, marc, dublin core, archive"),
    ("150", "Psychology", "psychology, mind, emotion, behaviour, behavior, memory"),
    ("170", "Ethics", "ethics, morality, virtue"),
    ("200", "Religion", "religion, god, faith, prayer, church, mosque, bible, quran, sermon"),
    ("320", "Political science", "politics, government, election, parliament, democracy, constitution"),
    ("330", "Economics", "economics, economy, market, inflation, trade, income"),
    ("332", "Financial economics", "bank, loan, mortgage, investment, savings, interest rate, pension, insurance, statement"),
    ("346", "Private law (contracts, property)", "lease, tenancy, tenant, landlord, rent, contract, agreement, deed, property, will, title deed, notice period"),
    ("336", "Public finance (taxes)", "tax, taxes, revenue authority, tax return, vat"),
    ("363", "Utilities and public services", "electricity, water bill, utility, bill, invoice, receipt"),
    ("370", "Education", "education, school, lecture, course, student, exam, teacher, university, syllabus, transcript"),
    ("392", "Customs of life cycle and domestic life", "ceremony, wedding, naming ceremony, funeral, birthday, outdooring, marriage, family"),
    ("398", "Folklore", "folklore, folktale, proverb, legend, myth, ananse"),
    ("400", "Language", "grammar, vocabulary, dictionary, language learning, pronunciation"),
    ("510", "Mathematics", "mathematics, algebra, calculus, geometry, statistics, equation"),
    ("530", "Physics", "physics, energy, force, quantum, motion"),
    ("570", "Biology", "biology, cell, gene, evolution, species, ecology"),
    ("610", "Medicine and health", "health, medicine, medical, doctor, hospital, prescription, vaccine, diagnosis, clinic, malaria"),
    ("630", "Agriculture", "farm, farming, crop, cocoa, harvest, livestock, soil"),
    ("641", "Food and drink (cooking)", "recipe, cooking, cook, food, kitchen, jollof, soup, bake, ingredient, dish"),
    ("650", "Management and business", "business, management, marketing, startup, strategy, sales"),
    ("700", "Arts", "art, painting, design, sculpture, drawing"),
    ("770", "Photography", "photograph, photo, camera, portrait"),
    ("780", "Music", "music, song, album, guitar, highlife, concert, melody"),
    ("790", "Sports and recreation", "football, sport, game, match, athletics, recreation"),
    ("800", "Literature", "novel, fiction, poetry, poem, story, short stories, drama, play"),
    ("823", "English fiction", ""),
    ("910", "Geography and travel", "travel, geography, map, journey, tourism, trip"),
    ("960", "History of Africa", "africa, ghana, nigeria, kenya, colonial, independence, igbo, ashanti, west africa"),
    ("900", "History", "history, war, empire, revolution, century"),
]

MONTHS = "january february march april may june july august september october november december".split()

#: Named character references that are decoded.
ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "rsquo": "'", "lsquo": "'", "ldquo": '"', "rdquo": '"',
    "nbsp": " ", "mdash": "—", "ndash": "–", "hellip": "…", "amp": "&",
}

#: How cameras, phones and scanners start a file's name, before a date and before a number.
DATED_NAMES = ["IMG", "VID", "PXL", "DSC", "DSCN", "DCIM", "MVIMG", "Screenshot", "WhatsApp Image", "WhatsApp Video", "AUD", "REC", "scan"]
NUMBERED_NAMES = ["IMG", "VID", "PXL", "DSC", "DSCN", "scan", "AUD", "REC"]

# End of the fixed values.

#: White space as the results define it, for Java and RE2.
SPACE = r"[\t\n\x0B\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
TYPE_OF_WORD = {w: t for t, ws in TYPE_WORDS.items() for w in ws.split()}
LANGUAGE_OF = {w: code for code, ws in LANGUAGE_CODES.items() for w in ws.split()}
MEDIA_OF_EXTENSION = {e: m for m, es in EXTENSIONS.items() for e in es.split()}
