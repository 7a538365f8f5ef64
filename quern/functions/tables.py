"""Word lists, character tables and patterns that results depend on.

All of these are plain data in natural order; the syllabary's phonemes follow from its rule.
"""

from __future__ import annotations

# --- fixed values: Amharic number words -------------------------------------------------------
ONES = (
    "", "አንድ", "ሁለት", "ሶስት", "አራት", "አምስት", "ስድስት", "ሰባት", "ስምንት", "ዘጠኝ", "አሥር",
    "አስራ አንድ", "አስራ ሁለት", "አስራ ሶስት", "አስራ አራት", "አስራ አምስት", "አስራ ስድስት", "አስራ ሰባት", "አስራ ስምንት", "አስራ ዘጠኝ",
)
TENS = ("", "", "ሃያ", "ሰላሳ", "አርባ", "ሃምሳ", "ስልሳ", "ሰባ", "ሰማንያ", "ዘጠና")
ZERO, MINUS, POINT = "ዜሮ", "መቀነስ", "ነጥብ"
HUNDRED, THOUSAND, MILLION, BILLION = "መቶ", "ሺህ", "ሚሊዮን", "ቢሊዮን"

# --- fixed values: Ethiopic numerals ----------------------------------------------------------
NUMERALS = dict(zip("፩፪፫፬፭፮፯፰፱፲፳፴፵፶፷፸፹፺፻፼", [*range(1, 10), *range(10, 100, 10), 100, 10000], strict=True))

# --- fixed values: spelling variants and abbreviations ----------------------------------------
#: Variants unified by normalisation; applied one after another.
VARIANTS = (("ሥ", "ስ"), ("ዕ", "እ"), ("ኅ", "ሕ"), ("ኽ", "ክ"), ("ዐ", "አ"), ("ኣ", "አ"), ("ሀ", "ሃ"))
#: Variants unified before phonemes are looked up.
G2P_VARIANTS = (
    ("ሥ", "ስ"), ("ዕ", "እ"), ("ፅ", "ጽ"), ("ኅ", "ህ"), ("ኽ", "ክ"), ("ሕ", "ህ"), ("ዐ", "አ"), ("ኣ", "አ"), ("ዓ", "አ"),
)
ABBREVIATIONS = {
    "ዓ.ም": "ዓመተ ምህረት", "ዓ.ም.": "ዓመተ ምህረት", "ዓ . ም": "ዓመተ ምህረት", "ዓ/ም": "ዓመተ ምህረት",
    "ዓ.ዓ": "ዓመተ ዓለም", "ዓ.ዓ.": "ዓመተ ዓለም", "ዓ/ዓ": "ዓመተ ዓለም",
    "ክ.ክ": "ክፍለ ከተማ", "ክ.ክ.": "ክፍለ ከተማ", "ክ . ክ": "ክፍለ ከተማ", "ክ/ክ": "ክፍለ ከተማ",
    "ት.ቤት": "ትምህርት ቤት", "ት/ቤት": "ትምህርት ቤት", "ት.ት": "ትምህርት ተቋም", "ት/ት": "ትምህርት ተቋም",
    "ኢ.ፌ.ዲ.ሪ": "የኢትዮጵያ ፌደራላዊ ዲሞክራሲያዊ ሪፐብሊክ", "ኢ/ፌ/ዲ/ሪ": "የኢትዮጵያ ፌደራላዊ ዲሞክራሲያዊ ሪፐብሊክ",
    "ም.ም": "መምህር", "ም/ም": "መምህር",
    "ዶ.ር": "ዶክተር", "ዶ.ር.": "ዶክተር", "ዶ . ር": "ዶክተር", "ዶ/ር": "ዶክተር",
    "ፕ.ር": "ፕሮፌሰር", "ፕ.ር.": "ፕሮፌሰር", "ፕ . ር": "ፕሮፌሰር", "ፕ/ር": "ፕሮፌሰር",
}
WORD_SPACE = "፡"

# --- fixed values: symbols and the words they are spoken as -----------------------------------
TEMPERATURES = {"°C": "ዲግሪ ሴልሲየስ", "°F": "ዲግሪ ፋራናይት", "°K": "ኬልቪን"}
CURRENCIES = {
    "$": "ዶላር", "€": "ዩሮ", "£": "ፓውንድ", "¥": "የን", "₹": "ሩፒ",
    "USD": "ዶላር", "EUR": "ዩሮ", "GBP": "ፓውንድ", "ETB": "ብር", "birr": "ብር", "Birr": "ብር",
}
SUFFIXES = {"%": "ፐርሰንት", "‰": "በሺ", "°": "ዲግሪ"}
#: The word of X ends in a letter of another script; results depend on it.
OPERATORS = {
    "+": "መደመር", "−": "መቀነስ", "-": "መቀነስ", "×": "ማባዛት", "x": "ማባዛት", "X": "ማባዛത", "÷": "መከፋፈል", "/": "በ", "=": "እኩል",
    "≈": "ይህ ያህል", "≠": "አይመስልም", "<": "ያነሰ", ">": "ይበልጣል", "≤": "ያነሰ ወይም እኩል", "≥": "ይበልጣል ወይም እኩል",
}
COMMON = {
    "&": "እና", "@": "በ", "#": "ቁጥር", "©": "የቅጂ መብት", "®": "የተመዘገበ", "™": "የንግድ ምልክት", "§": "ክፍል", "†": "መስቀል", "‡": "ድርብ መስቀል",
}
FALLBACK = {
    "/": "ሀዝባር", "\\": "ተቃራኒ ሀዝባር", "|": "ቀጥተኛ መስመር", "(": "ክፍት ቅንፍ", ")": "ዝግ ቅንፍ", "[": "ክፍት አራት ማዕዘን", "]": "ዝግ አራት ማዕዘን",
    "{": "ክፍት ሰንደቅ", "}": "ዝግ ሰንደቅ", '"': "ድርብ ጥቅስ", "'": "ነጠላ ጥቅስ", "`": "የኋላ ጥቅስ", "!": "መለያ ምልክት", "?": "ጥያቄ ምልክት",
    ".": "ነጥብ", ",": "ኮማ", ";": "ሴሚኮሎን", ":": "ኮሎን", "…": "ሶስት ነጥብ", "*": "ኮከብ", "^": "ሃይል", "~": "ሞገድ", "_": "ስር መስመር",
}

# --- fixed values: punctuation and prosody ----------------------------------------------------
PUNCTUATION = {"።": ".", "፣": ",", "፤": ";", "፥": ":", "፦": "::", "፧": "?", "፨": "¶", "፡": " "}
PAUSES = {
    ",": "0.2", "፣": "0.2", ";": "0.3", "፤": "0.3", ":": "0.3", "፥": "0.3", ".": "0.5", "።": "0.5", "!": "0.5", "?": "0.5",
    "፧": "0.5", "¶": "0.8", "፨": "0.8", "::": "0.4", "፦": "0.4",
}
INTONATIONS = {"?": "rising", "፧": "rising", "!": "emphatic", ".": "falling", "።": "falling"}
EMPHASIS = (
    ("[A-Z]{2,}", "caps_emphasis"), (r"\*\*(.+?)\*\*", "bold_emphasis"), ("_(.+?)_", "italic_emphasis"),
    ("!+", "multiple_exclaim"), (r"\?+", "multiple_question"),
)

# --- phonemes: built from the syllabary's rule ------------------------------------------------
#: Each consonant's seven orders follow one another in Unicode; their vowels:
VOWELS = ("ə", "u", "i", "a", "e", "ɨ", "o")
#: First-order letter and consonant.
CONSONANTS = {
    "ሀ": "h", "ለ": "l", "ሐ": "ħ", "መ": "m", "ሠ": "s", "ረ": "r", "ሰ": "s", "ሸ": "ʃ", "ቀ": "q", "በ": "b", "ተ": "t", "ቸ": "tʃ",
    "ኀ": "x", "ነ": "n", "ኘ": "ɲ", "አ": "ʔ", "ከ": "k", "ኸ": "x", "ወ": "w", "ዐ": "ʕ", "ዘ": "z", "ዠ": "ʒ", "የ": "j", "ደ": "d",
    "ጀ": "dʒ", "ገ": "g", "ጠ": "tʼ", "ጨ": "tʃʼ", "ጰ": "pʼ", "ጸ": "sʼ", "ፀ": "sʼ", "ፈ": "f", "ፐ": "p",
}
#: Labiovelars: first letter and consonant; the forms lie 0, 2, 3, 4 and 5 places on.
LABIOVELARS = {"ቈ": "qʷ", "ኰ": "kʷ", "ጐ": "gʷ", "ዀ": "xʷ"}
LABIOVELAR_FORMS = ((0, "ə"), (2, "u"), (3, "a"), (4, "e"), (5, "i"))


def phonemes() -> dict[str, str]:
    """Every character with a phoneme: 231 syllables, 20 labiovelars and 8 marks."""
    out = {chr(ord(c) + i): p + v for c, p in CONSONANTS.items() for i, v in enumerate(VOWELS)}
    out |= {chr(ord(c) + i): p + v for c, p in LABIOVELARS.items() for i, v in LABIOVELAR_FORMS}
    return out | PUNCTUATION


# --- fixed values: labiovelars of the fallback ------------------------------------------------
LABIOVELARS_FALLBACK = {
    "ቈ": "qʷə", "ቊ": "qʷu", "ቋ": "qʷa", "ቌ": "qʷe", "ቍ": "qʷɨ",
    "ኰ": "kʷə", "ኲ": "kʷu", "ኳ": "kʷa", "ኴ": "kʷe", "ኵ": "kʷɨ",
    "ዀ": "xʷə", "ዂ": "xʷu", "ዃ": "xʷa", "ዄ": "xʷe", "ዅ": "xʷɨ",
    "ጐ": "gʷə", "ጒ": "gʷu", "ጓ": "gʷa", "ጔ": "gʷe", "ጕ": "gʷɨ",
}

# --- fixed values: the older, smaller profile -------------------------------------------------
BASIC_VARIANTS = (("ሥ", "ስ"), ("ዕ", "እ"), ("ፅ", "ጽ"), ("ኅ", "ህ"), ("ኽ", "ክ"), ("ሕ", "ህ"), ("ዐ", "አ"), ("ኣ", "አ"))
BASIC_WORDS = {"ሰላም": "səlam"}
BASIC_PHONEMES = {
    "ሁ": "hu", "ሂ": "hi", "ሃ": "ha", "ሄ": "he", "ህ": "h", "ሆ": "ho",
    "ለ": "lə", "ሉ": "lu", "ሊ": "li", "ላ": "la", "ሌ": "le", "ል": "lə", "ሎ": "lo", "ሐ": "h",
    "መ": "mə", "ሙ": "mu", "ሚ": "mi", "ማ": "ma", "ሜ": "me", "ም": "mə", "ሞ": "mo", "ሠ": "s",
    "ረ": "rə", "ሩ": "ru", "ሪ": "ri", "ራ": "ra", "ሬ": "re", "ር": "rə", "ሮ": "ro",
    "ሰ": "sə", "ሱ": "su", "ሲ": "si", "ሳ": "sa", "ሴ": "se", "ስ": "sə", "ሶ": "so",
    "ሸ": "ʃə", "ሹ": "ʃu", "ሺ": "ʃi", "ሻ": "ʃa", "ሼ": "ʃe", "ሽ": "ʃə", "ሾ": "ʃo", "ቀ": "qə", "ቅ": "qə",
    "በ": "bə", "ቡ": "bu", "ቢ": "bi", "ባ": "ba", "ቤ": "be", "ብ": "bə", "ቦ": "bo",
    "ተ": "tə", "ቱ": "tu", "ቲ": "ti", "ታ": "ta", "ቴ": "te", "ት": "tə", "ቶ": "to", "ቸ": "tʃə", "ች": "tʃə", "ኀ": "h",
    "ነ": "nə", "ኑ": "nu", "ኒ": "ni", "ና": "na", "ኔ": "ne", "ን": "nə", "ኖ": "no", "ኘ": "ɲə", "ኝ": "ɲə",
    "አ": "ʔə", "እ": "ʔə", "ከ": "kə", "ኩ": "ku", "ኪ": "ki", "ካ": "ka", "ኬ": "ke", "ክ": "kə", "ኮ": "ko", "ኸ": "xə",
    "ወ": "wə", "ዉ": "wu", "ዊ": "wi", "ዋ": "wa", "ዌ": "we", "ው": "wə", "ዎ": "wo", "ዐ": "ʕə", "ዕ": "ʕə",
    "ዘ": "zə", "ዙ": "zu", "ዚ": "zi", "ዛ": "za", "ዜ": "ze", "ዝ": "zə", "ዞ": "zo", "ዠ": "ʒə", "ዥ": "ʒə",
    "የ": "jə", "ዩ": "ju", "ዪ": "ji", "ያ": "ja", "ዬ": "je", "ይ": "jə", "ዮ": "jo",
    "ደ": "də", "ዱ": "du", "ዲ": "di", "ዳ": "da", "ዴ": "de", "ድ": "də", "ዶ": "do", "ጀ": "dʒə", "ጅ": "dʒə",
    "ገ": "gə", "ጉ": "gu", "ጊ": "gi", "ጋ": "ga", "ጌ": "ge", "ግ": "gə", "ጎ": "go", "ጠ": "tʼə", "ጥ": "tʼə",
    "ጨ": "tʃʼə", "ጭ": "tʃʼə", "ጰ": "pʼə", "ጵ": "pʼə", "ጸ": "sʼə", "ጽ": "sʼə", "ፀ": "sʼə",
    "ፈ": "fə", "ፉ": "fu", "ፊ": "fi", "ፋ": "fa", "ፌ": "fe", "ፍ": "fə", "ፎ": "fo", "ፐ": "pə", "ፕ": "pə",
}
#: Its labiovelars stand apart; the row of ኸ is a plain one.
BASIC_LABIOVELARS = {
    "ቈ": "qʷi", "ቊ": "qʷu", "ቋ": "qʷa", "ቌ": "qʷe", "ቍ": "qʷɨ",
    "ኰ": "kʷi", "ኲ": "kʷu", "ኳ": "kʷa", "ኴ": "kʷe", "ኵ": "kʷɨ",
    "ኸ": "xʷi", "ኺ": "xʷu", "ኻ": "xʷa", "ኼ": "xʷe", "ኽ": "xʷɨ",
    "ጐ": "gʷi", "ጒ": "gʷu", "ጓ": "gʷa", "ጔ": "gʷe", "ጕ": "gʷɨ",
}

# --- fixed values: phonological patterns ------------------------------------------------------
EPENTHESIS = (
    "([kgqxKGQX])([bcdfghjklmnpqrstvwxyzʃʒʔʕʼBCDFGHJKLMNPQRSTVWXYZʃʒʔʕʼ])",
    "([tpskʃ]ʼ)([bcdfghjklmnpqrstvwxyzʃʒʔʕBCDFGHJKLMNPQRSTVWXYZʃʒʔʕ])",
    "([bdfhjlmnprstvwyzʃʒʔʕBDFHJLMNPRSTVWYZʃʒʔʕ])([bcdfghjklmnpqrstvwxyzʃʒʔʕBCDFGHJKLMNPQRSTVWXYZʃʒʔʕ])",
    r"([bdfghjkpqstvxzʃʒʔʕʼBDFGHJKPQSTVXZʃʒʔʕʼ])(\s|$|[።፣፤፥፧፨])",
)
GEMINATES = (
    "bb", "dd", "ff", "gg", "jj", "kk", "ll", "mm", "nn", "pp", "qq", "rr", "ss", "tt", "ww", "zz", "ʃʃ", "ʒʒ", "ɲɲ",
    "tʼtʼ", "pʼpʼ", "sʼsʼ", "kʼkʼ", "tʃʼtʃʼ",
)
G2P_VOWELS, G2P_IPA = "aeiouɨəAEIOU", "ɨəɲʃʒʔʕʷʼ"
#: Least share of vowels, most of Ethiopic, least of IPA, least length against the input.
G2P_LIMITS = (0.25, 0.1, 0.5, 0.5)

# --- fixed values: cleaners of several languages ----------------------------------------------
#: Abbreviation -> word by language, in order; matched as a word and a full stop, any case.
LANG_ABBREVIATIONS = {
    "en": (("mrs", "misess"), ("mr", "mister"), ("dr", "doctor"), ("st", "saint"), ("co", "company"), ("jr", "junior"), ("maj", "major"), ("gen", "general"), ("drs", "doctors"), ("rev", "reverend"), ("lt", "lieutenant"), ("hon", "honorable"), ("sgt", "sergeant"), ("capt", "captain"), ("esq", "esquire"), ("ltd", "limited"), ("col", "colonel"), ("ft", "fort")),
    "es": (("sra", "señora"), ("sr", "señor"), ("dr", "doctor"), ("dra", "doctora"), ("st", "santo"), ("co", "compañía"), ("jr", "junior"), ("ltd", "limitada")),
    "fr": (("mme", "madame"), ("mr", "monsieur"), ("dr", "docteur"), ("st", "saint"), ("co", "compagnie"), ("jr", "junior"), ("ltd", "limitée")),
    "de": (("fr", "frau"), ("dr", "doktor"), ("st", "sankt"), ("co", "firma"), ("jr", "junior")),
    "pt": (("sra", "senhora"), ("sr", "senhor"), ("dr", "doutor"), ("dra", "doutora"), ("st", "santo"), ("co", "companhia"), ("jr", "júnior"), ("ltd", "limitada")),
    "it": (("sig", "signore"), ("dr", "dottore"), ("st", "santo"), ("co", "compagnia"), ("jr", "junior"), ("ltd", "limitata")),
    "pl": (("p", "pani"), ("m", "pan"), ("dr", "doktor"), ("sw", "święty"), ("jr", "junior")),
    "cs": (("dr", "doktor"), ("ing", "inženýr"), ("p", "pan")),
    "ru": (("г-жа", "госпожа"), ("г-н", "господин"), ("д-р", "доктор")),
    "nl": (("dhr", "de heer"), ("mevr", "mevrouw"), ("dr", "dokter"), ("jhr", "jonkheer")),
    "tr": (("b", "bay"), ("byk", "büyük"), ("dr", "doktor")),
    "hu": (("dr", "doktor"), ("b", "bácsi"), ("nőv", "nővér")),
    "ja": (("氏", "さん"), ("夫人", "おんなのひと"), ("博士", "はかせ"), ("株", "株式会社"), ("有", "有限会社"), ("大学", "だいがく"), ("先生", "せんせい"), ("君", "くん")),
    "ar": (), "zh": (), "ko": (),
}
SYMBOL_KEYS = "&@%#$£°"
#: Words for those seven symbols.
LANG_SYMBOLS = {
    "en": ("and", "at", "percent", "hash", "dollar", "pound", "degree"),
    "es": ("y", "arroba", "por ciento", "numeral", "dolar", "libra", "grados"),
    "fr": ("et", "arobase", "pour cent", "dièse", "dollar", "livre", "degrés"),
    "de": ("und", "at", "prozent", "raute", "dollar", "pfund", "grad"),
    "pt": ("e", "arroba", "por cento", "cardinal", "dólar", "libra", "graus"),
    "it": ("e", "chiocciola", "per cento", "cancelletto", "dollaro", "sterlina", "gradi"),
    "pl": ("i", "małpa", "procent", "krzyżyk", "dolar", "funt", "stopnie"),
    "ar": ("و", "على", "في المئة", "رقم", "دولار", "جنيه", "درجة"),
    "zh": ("和", "在", "百分之", "号", "美元", "英镑", "度"),
    "cs": ("a", "na", "procento", "křížek", "dolar", "libra", "stupně"),
    "ru": ("и", "собака", "процентов", "номер", "доллар", "фунт", "градус"),
    "nl": ("en", "bij", "procent", "hekje", "dollar", "pond", "graden"),
    "tr": ("ve", "at", "yüzde", "diyez", "dolar", "sterlin", "derece"),
    "hu": ("és", "kukac", "százalék", "kettőskereszt", "dollár", "font", "fok"),
    "ko": ("그리고", "에", "퍼센트", "번호", "달러", "파운드", "도"),
    "ja": ("と", "アットマーク", "パーセント", "ナンバー", "ドル", "ポンド", "度"),
}
CHAR_LIMITS = {
    "en": 250, "de": 253, "fr": 273, "es": 239, "it": 213, "pt": 203, "pl": 224, "zh": 82, "ar": 166, "cs": 186, "ru": 182,
    "nl": 251, "tr": 226, "ja": 71, "hu": 224, "ko": 95, "am": 200, "amh": 200,
}
CHAR_LIMIT = 250

# --- fixed values: language codes -------------------------------------------------------------
AMHARIC_CODES = ("am", "amh", "amharic", "አማርኛ", "am-et")
