"""Word lists, code points, patterns and thresholds of the land-record domain.

Everything here is a fixed value: results are defined by these lists in this order.
"""

# --- scripts: name, first and last code point, language (fixed values) ---
SCRIPTS = [
    ("Devanagari", 0x0900, 0x097F, "hi"),
    ("Bengali", 0x0980, 0x09FF, "bn"),
    ("Gurmukhi", 0x0A00, 0x0A7F, "pa"),
    ("Gujarati", 0x0A80, 0x0AFF, "gu"),
    ("Odia", 0x0B00, 0x0B7F, "or"),
    ("Tamil", 0x0B80, 0x0BFF, "ta"),
    ("Telugu", 0x0C00, 0x0C7F, "te"),
    ("Kannada", 0x0C80, 0x0CFF, "kn"),
    ("Malayalam", 0x0D00, 0x0D7F, "ml"),
    ("Arabic", 0x0600, 0x06FF, "ur"),
    ("Latin", 0x0041, 0x007A, "en"),
]
LANGUAGE_NAMES = {
    "hi": "Hindi", "mr": "Marathi", "ta": "Tamil", "te": "Telugu", "kn": "Kannada", "ml": "Malayalam",
    "gu": "Gujarati", "bn": "Bengali", "pa": "Punjabi", "or": "Odia", "ur": "Urdu", "en": "English",
}
#: Words that tell Marathi from Hindi.
MARATHI = [
    "गाव", "तालुका", "जिल्हा", "नमुना", "अभिलेखा", "अभिलेख", "भोगवटदार", "खातेदार", "हक्क", "मालिक", "फेरफार",
    "सात", "१२", "आकारणी", "क्षेत्रफळ", "महाराष्ट्र", "नमुने", "सर्व्हे", "क्षेत्र", "पोट", "खराब",
]
#: Order in which ties between scripts are settled by the two other detectors.
DETECTOR_B = ["ta", "te", "kn", "ml", "gu", "bn", "pa", "hi"]
DETECTOR_C = ["hi", "ta", "te", "kn", "ml", "gu", "bn", "pa", "or"]

# --- digits: first code point of each script's ten digits (fixed values) ---
DIGIT_ZEROS = {"Devanagari": 0x0966, "Gujarati": 0x0AE6, "Bengali": 0x09E6, "Gurmukhi": 0x0A66, "Odia": 0x0B66, "Telugu": 0x0C66, "Kannada": 0x0CE6, "Malayalam": 0x0D66, "Tamil": 0x0BE6}
#: What the original map leaves alone, and the one glyph that it reads as another digit.
DIGITS_UNMAPPED = [0x0B66, 0x0B6E, 0x0C66, *range(0x0BE6, 0x0BF0)]
DIGITS_MISREAD = {0x0A6E: "0"}

# --- document types (fixed values); the pattern 8A is upper case and never meets lowered text ---
DOCUMENT_TYPES = [
    ("Sale Deed", [
        r"sale\s*deed", r"conveyance\s*deed", r"विक्रय\s*पत्र", r"विक्रयदस्त", r"खरेदी\s*खत", r"seller", r"purchaser", r"buyer",
        r"consideration\s*amount", r"stamp\s*duty", r"previous\s*owner", r"new\s*owner", r"deed\s*number", r"sub[\-\s]*registrar",
    ]),
    ("Mutation Record", [r"mutation", r"dakhil\s*kharij", r"फेरफार", r"दाखिल\s*खारिज", r"transfer\s*of\s*ownership", r"mutation\s*no"]),
    ("Lease Deed", [r"lease\s*deed", r"lessee", r"lessor", r"पट्टा", r"annual\s*rent", r"lease\s*period", r"tenancy"]),
    ("Record of Rights", [
        r"record\s*of\s*rights", r"7/12", r"8A", r"jamabandi", r"अधिकार\s*अभिलेख", r"जमाबंदी", r"खतौनी", r"khasra", r"khatauni", r"khata", r"भूमिस्वामी",
    ]),
    ("Registration Document", [r"^registration\s*(?:office|department)", r"registry\s*office", r"नोंदणी", r"पंजीकरण"]),
    ("Cadastral Record", [r"cadastr", r"survey\s*map", r"plot\s*map", r"bhunaksha", r"भूनक्शा"]),
]

# --- labels and values (fixed values) ---
SEPARATORS = r"[:：\-–—=]"
NOISE_LABELS = ["", "page", "date", "total", "rs", "no", "sr", "sl", "the", "and", "for", "this", "that", "with", "from"]
CANONICAL = [
    ("SURVEY_NUMBER", ["survey no", "survey number", "s.no", "s no", "सर्वे नं", "सर्वे नंबर", "सर्व्हे नं", "भूमापन क्रमांक", "गट क्रमांक", "गट नं"]),
    ("KHASRA_NUMBER", ["khasra", "khasra no", "खसरा", "खसरा नं", "खसरा संख्या"]),
    ("KHATA_NUMBER", ["khata", "khata no", "khata number", "खाता", "खाता संख्या", "खातेदार", "खाते क्रमांक", "खाते नं"]),
    ("PLOT_NUMBER", ["plot no", "plot number", "p.no", "p no"]),
    ("VILLAGE", ["village", "gram", "gaon", "गाँव", "ग्राम", "गांव", "मौजे", "गाव"]),
    ("TEHSIL", ["tehsil", "taluka", "taluk", "तहसील", "तालुका"]),
    ("DISTRICT", ["district", "dist", "zilla", "जिला", "जिल्हा"]),
    ("OWNER_NAME", ["owner", "owner name", "owner's name", "malik", "मालिक", "मालिक का नाम", "भूमिस्वामी", "खातेदाराचे नाव", "मालकाचे नाव"]),
    ("FATHER_NAME", ["father", "father's name", "father name", "s/o", "pitaji", "वडिलांचे नाव", "पिता"]),
    ("MOTHER_NAME", ["mother", "mother's name", "mother name", "w/o", "माता", "mataji"]),
    ("AREA", ["area", "क्षेत्रफल", "क्षेत्र", "आकारणी", "hectare", "acre"]),
    ("REGISTRATION_NUMBER", ["registration no", "reg no", "deed no", "document no", "नोंदणी", "दस्त"]),
    ("MUTATION_NUMBER", ["mutation", "mutation no", "dakhil kharij", "फेरफार", "दाखिल खारिज"]),
    ("REGISTRATION_DATE", ["registration date", "date of registration", "deed date", "दिनांक", "तारीख"]),
    ("STAMP_DUTY", ["stamp duty", "stamp", "मुद्रांक शुल्क"]),
    ("CONSIDERATION_AMOUNT", ["consideration", "consideration amount", "sale amount", "विक्रय मूल्य"]),
    (None, ["witness", "witness 1", "witness 2", "साक्षी", "गवाह"]),
    ("PREVIOUS_OWNER", ["previous owner", "seller", "vendor", "विक्रेता"]),
    ("NEW_OWNER", ["new owner", "purchaser", "buyer", "vendee", "क्रेता"]),
    ("LEASE_NUMBER", ["lease", "lease no", "lease number", "पट्टा"]),
    ("LESSEE", ["lessee", "पट्टाधारक"]),
    ("LESSOR", ["lessor", "पट्टादाता"]),
    ("LEASE_PERIOD", ["lease period", "पट्टा अवधि"]),
    ("ANNUAL_RENT", ["annual rent", "rent", "वार्षिक किराया"]),
    ("PROPERTY_DESCRIPTION", ["property description", "property detail", "संपत्ति विवरण"]),
]
PERSON_WORDS = ["name", "owner", "father", "mother", "witness", "seller", "buyer", "purchaser", "vendor", "vendee", "lessee", "lessor", "नाम", "नाव", "मालिक", "पिता", "माता"]
DATE_WORDS = ["date", "दिनांक", "तारीख"]
AREA_WORDS = ["area", "क्षेत्रफल", "क्षेत्र", "hectare", "acre"]
CURRENCY_WORDS = ["duty", "amount", "price", "rent", "मूल्य", "किराया", "शुल्क"]
ADDRESS_WORDS = ["village", "district", "tehsil", "taluka", "address", "गाव", "जिला", "जिल्हा", "तहसील", "तालुका", "पता"]
IDENTIFIER_WORDS = ["no", "number", "no.", "id", "code", "नं", "नंबर", "संख्या", "क्रमांक"]
DATE_VALUE = r"^\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}$|^\d{1,2}\s+\w+\s+\d{4}$"
CURRENCY_VALUE = r"(?:rs\.?|₹|inr)\s*[\d,]+"
AREA_VALUE = r"\d+\.?\d*\s*(?:hectare|acre|sq\.?\s*m|ha\.?|एकड़|हेक्टेयर|हेक्टर)"
NUMBER_VALUE = r"^[\d,]+\.?\d*$"

# --- terms and their English (fixed values); the first one contained in a value wins ---
TERMS = [
    ("खसरा", "Khasra"), ("खसरा संख्या", "Khasra Number"), ("खसरा नं", "Khasra Number"), ("सर्वे", "Survey"),
    ("सर्वे नंबर", "Survey Number"), ("सर्वे नं", "Survey Number"), ("खाता", "Khata"), ("खाता संख्या", "Khata Number"),
    ("खाता नं", "Khata Number"), ("गाव", "Village"), ("गाँव", "Village"), ("ग्राम", "Village"), ("तालुका", "Tehsil/Taluka"),
    ("तहसील", "Tehsil/Taluka"), ("जिल्हा", "District"), ("जिला", "District"), ("क्षेत्रफल", "Area"), ("क्षेत्र", "Area"),
    ("हेक्टर", "Hectares"), ("एकड़", "Acres"), ("कृषि", "Agricultural"), ("शेती", "Agricultural"), ("अकृषि", "Non-Agricultural"),
    ("बिनशेती", "Non-Agricultural"), ("मालिक", "Owner"), ("मालिकाचे नाव", "Owner Name"), ("दिनांक", "Date"), ("रजिस्ट्रेशन", "Registration"),
    ("பட்டா", "Patta"), ("பட்டா எண்", "Patta Number"), ("புல எண்", "Survey Number"), ("கிராமம்", "Village"), ("வட்டம்", "Taluk"),
    ("மாவட்டம்", "District"), ("பரப்பளவு", "Area"), ("உரிமையாளர்", "Owner"), ("நஞ்சை", "Wet Land (Nanja)"), ("புஞ்சை", "Dry Land (Punja)"),
    ("పట్టా", "Patta"), ("ఖాతా సంఖ్య", "Khata Number"), ("సర్వే నంబర్", "Survey Number"), ("గ్రామం", "Village"), ("మండలం", "Mandal"),
    ("జిల్లా", "District"), ("పట్టాదారు", "Land Owner"), ("విస్తీర్ణం", "Area"), ("ಖಾತಾ ಸಂಖ್ಯೆ", "Khata Number"), ("ಸರ್ವೇ ನಂಬರ್", "Survey Number"),
    ("ಗ್ರಾಮ", "Village"), ("ತಾಲೂಕು", "Taluk"), ("ಜಿಲ್ಲೆ", "District"), ("ಮಾಲೀಕರು", "Owner"), ("ವಿಸ್ತೀರ್ಣ", "Area"),
    ("ખાતા નંબર", "Khata Number"), ("સર્વે નંબર", "Survey Number"), ("ગામ", "Village"), ("તાલુકો", "Taluka"), ("જિલ્લો", "District"),
    ("ક્ષેત્રફળ", "Area"), ("খতিয়ান", "Khatian"), ("দাগ নং", "Dag Number"), ("মৌজা", "Mouza/Village"), ("জেলা", "District"),
    ("জমির পরিমাণ", "Land Area"), ("ਖਸਰਾ", "Khasra"), ("ਖੇਵਟ", "Khewat"), ("ਖਤੌਨੀ", "Khatauni"), ("ਪਿੰਡ", "Village"), ("ਤਹਿਸੀਲ", "Tehsil"),
    ("ਜ਼ਿਲ੍ਹਾ", "District"), ("ਰਕਬਾ", "Area"), ("ਜਮ੍ਹਾਬੰਦੀ", "Jamabandi (Record of Rights)"), ("സർവേ", "Survey"), ("സർവേ നമ്പർ", "Survey Number"),
    ("വില്ലേജ്", "Village"), ("താലൂക്ക്", "Taluk"), ("ജില്ല", "District"), ("ഉടമസ്ഥൻ", "Owner"), ("വിസ്തീർണം", "Area"), ("കരം", "Land Tax"),
    ("തണ്ടപ്പേര്", "Thandapper (Holding Number)"), ("ଖାତା", "Khata"), ("ଖାତା ନଂ", "Khata Number"), ("ପ୍ଲଟ", "Plot"), ("ପ୍ଲଟ ନଂ", "Plot Number"),
    ("ମୌଜା", "Mouza/Village"), ("ତହସିଲ", "Tehsil"), ("ଜିଲ୍ଲା", "District"), ("ଜମି ମାଲିକ", "Land Owner"), ("ରୟତ", "Tenant/Owner"),
    ("خسرہ", "Khasra"), ("کھتونی", "Khatauni"), ("موضع", "Mauza/Village"), ("تحصیل", "Tehsil"), ("ضلع", "District"), ("مالک", "Owner"),
    ("رقبہ", "Area"), ("فرد", "Fard (Land Record Copy)"), ("দাগ", "Dag Number"), ("পাট্টা", "Patta"), ("মৌজা", "Mouza"), ("ৰাজহ", "Revenue"),
    ("মাটিকালি", "Land Area"),
]
#: Entity types whose values are never translated.
UNTRANSLATED = ["OWNER_NAME", "FATHER_NAME", "MOTHER_NAME", "SURVEY_NUMBER", "KHASRA_NUMBER", "KHATA_NUMBER", "PLOT_NUMBER", "REGISTRATION_NUMBER", "MUTATION_NUMBER"]

# --- keys (fixed values) ---
DUPLICATE_KEYS = ["SURVEY_NUMBER", "KHASRA_NUMBER", "KHATA_NUMBER", "PLOT_NUMBER", "OWNER_NAME", "VILLAGE", "DISTRICT"]
DATE_FORMATS = ["d-M-yyyy", "d/M/yyyy", "d.M.yyyy", "d-M-yy", "d/M/yy", "d MMMM yyyy", "d MMM yyyy", "yyyy-M-d"]
RULE_DATE_FORMATS = ["d-M-yyyy", "d/M/yyyy", "yyyy-M-d", "d.M.yyyy", "d MMM yyyy", "d MMMM yyyy"]
SQUARE_METRES = {"hectare": 10000.0, "ha": 10000.0, "acre": 4046.86, "ac": 4046.86, "bigha": 2529.28, "gunta": 101.17, "cent": 40.47, "sqm": 1.0, "sqft": 0.0929}
CONFIDENCE_FLOORS = [("HIGH", 0.85), ("MEDIUM", 0.60), ("LOW", 0.30)]
STATES = {
    "MH": ["MH", "MAHARASHTRA"], "UP": ["UP", "UTTAR PRADESH"], "MP": ["MP", "MADHYA PRADESH"], "TN": ["TN", "TAMIL NADU"],
    "AP_TS": ["AP", "ANDHRA PRADESH", "TS", "TELANGANA"], "KA": ["KA", "KARNATAKA"], "WB": ["WB", "WEST BENGAL"],
}
PADDY_WORDS = ["nanja", "punja", "wet", "dry", "நஞ்சை", "புஞ்சை", "agricultural"]

# --- fields, files, land classes and models (fixed values) ---
#: Words before a colon that make a block a field (fixed values).
FIELD_WORDS = [
    "survey", "khasra", "khata", "plot", "village", "tehsil", "district", "owner", "father", "mother", "area", "registration",
    "mutation", "date", "सर्वे", "खसरा", "खाता", "गाव", "तालुका", "जिल्हा", "मालिक", "क्षेत्र",
]
#: Marks in a file name and the type they stand for, the first that fits (fixed values).
FILE_TYPES = [
    (["7_12", "satbara"], "7/12 Extract (सातबारा)"),
    (["khasra", "khatauni"], "Khasra-Khatauni (खतौनी)"),
    (["patta"], "Patta/Chitta (பட்டா)"),
]
#: Colours of land classes, the first contained (fixed values).
CLASS_COLOURS = [
    ("agricultural", "#16a34a"), ("residential", "#2563eb"), ("commercial", "#d97706"), ("forest", "#065f46"),
    ("wasteland", "#6b7280"), ("water", "#0284c7"), ("government", "#7c3aed"), ("default", "#b45309"),
]
#: Languages with a printed-text model of their own (fixed values).
PADDLE_LANGUAGES = ["hi", "mr", "ta", "te", "kn", "ml", "gu", "bn", "pa", "en"]
#: Words that tie an anomaly to a field, in order (fixed values).
ANOMALY_WORDS = ["area", "date", "market_value", "owner"]

# --- anomaly model (fixed values): features in order, and the distributions of the rows that it learns from ---
ANOMALY_FEATURES = ["area", "number_of_owners", "mutation_frequency", "numeric_field_consistency", "unusual_area_values", "unusual_record_patterns"]
TRAINING_ROWS, CONTAMINATION, TRAINING_SEED = 500, 0.05, 42
NORMAL_ROWS = {"area": (0.1, 20), "owners": [1, 2, 3, 4], "owner_shares": [0.5, 0.3, 0.15, 0.05], "mutations": 0.8, "consistency": (0.9, 1), "patterns": (0, 0.1)}
ODD_ROWS = {"log_area": [0, -1], "large_area": 15000, "owners": [0, 50, 120], "mutations": (15, 50), "consistency": (0, 0.3), "area_values": [0.8, 1.0], "patterns": (0.6, 1)}

# --- entity patterns (fixed values): type, confidence, pattern ---
ENTITY_PATTERNS = {
    "en": [
        ("SURVEY_NUMBER", 0.90, r"(?:survey\s*no\.?|survey\s*number|s\.?\s*no\.?)\s*[:\-]?\s*([A-Z0-9/\-\.]+)"),
        ("KHASRA_NUMBER", 0.88, r"(?:khasra\s*no\.?|khasra\s*number|khasrauni|khasra)\s*[:\-]?\s*([0-9/\-\.]+)"),
        ("KHATA_NUMBER", 0.88, r"(?:khata\s*no\.?|khata\s*number|khatauni|khata)\s*[:\-]?\s*([0-9/\-\.]+)"),
        ("PLOT_NUMBER", 0.85, r"(?:plot\s*no\.?|plot\s*number|p\.?\s*no\.?)\s*[:\-]?\s*([A-Z0-9/\-\.]+)"),
        ("VILLAGE", 0.80, r"(?:village|gram|gaon|gramin)\s*[:\-]?\s*([A-Za-zऀ-ॿ][A-Za-zऀ-ॿ\s]{2,28})(?=\s{2,}|[\n,.]|\s+(?:Tehsil|District|State|Taluka|Area|Owner|Reg|Doc|Pin)|$)"),
        ("TEHSIL", 0.80, r"(?:tehsil|taluka|taluk|t\.?\s*q\.?)\s*[:\-]?\s*([A-Za-zऀ-ॿ][A-Za-zऀ-ॿ\s]{2,28})(?=\s{2,}|[\n,.]|\s+(?:District|State|Area|Owner|Reg|Doc|Pin|Village)|$)"),
        ("DISTRICT", 0.80, r"(?:district|dist\.?|zilla)\s*[:\-]?\s*([A-Za-zऀ-ॿ][A-Za-zऀ-ॿ\s]{2,28})(?=\s{2,}|[\n,.]|\s+(?:State|Area|Owner|Reg|Doc|Pin|Village|Taluka)|$)"),
        ("AREA", 0.85, r"([0-9]+(?:\.[0-9]+)?)\s*(?:hectare|hectares|ha\.?|acre|acres|ac\.?|sq\.?\s*m\.?|square\s*met(?:re|er)s?)"),
        ("REGISTRATION_NUMBER", 0.85, r"(?:registration\s*no\.?|reg\.?\s*no\.?|deed\s*no\.?|document\s*no\.?)\s*[:\-]?\s*([A-Z0-9/\-\.]+)"),
        ("MUTATION_NUMBER", 0.82, r"(?:mutation\s*no\.?|dakhil\s*kharij|dakhil\s*khari)\s*[:\-]?\s*([0-9/\-\.]+)"),
        ("DATE", 0.90, r"(?:registration\s*date|date\s*of\s*registration|deed\s*date|executed\s*on|date\s*of\s*execution)\s*[:\-]?\s*(\d{1,2}[\-/\.]\d{1,2}[\-/\.]\d{2,4}|\d{1,2}\s+\w+\s+\d{4})"),
        ("OWNER_NAME", 0.75, r"(?:owner(?:'s)?\s*name|malik\s*ka\s*naam|bhumiswami|vendee|purchaser)\s*[:\-]?\s*([A-Za-zऀ-ॿ][A-Za-zऀ-ॿ\s\.]{2,59})(?=s/o|w/o|d/o|[\n,.]|\s{2,}|$)"),
        ("FATHER_NAME", 0.72, r"(?:father['’']?\s*(?:name|s\s+name)|father\s*name|s/o|s\.?\s*o\.?|father|pitaji|pitamah)\s*[:\-]?\s*([A-Za-zऀ-ॿ][A-Za-zऀ-ॿ\s\.]{2,59})"),
        ("MOTHER_NAME", 0.72, r"(?:mother['’']?\s*(?:name|s\s+name)|mother\s*name|w/o|w\.?\s*o\.?|mother|mataji|mata)\s*[:\-]?\s*([A-Za-zऀ-ॿ][A-Za-zऀ-ॿ\s\.]{2,59})"),
    ],
    "hi": [
        ("SURVEY_NUMBER", 0.90, r"(?:सर्वे\s*नं\.?|सर्वे\s*नंबर|सर्वे|खसरा\s*नं\.?|खसरा\s*संख्या|खसरा)\s*[:\-]?\s*([0-9०-९A-Za-z\/\-\.]+)"),
        ("KHATA_NUMBER", 0.88, r"(?:खाता\s*संख्या|खाता\s*नं\.?|खाता|खतौनी)\s*[:\-]?\s*([0-9०-९A-Za-z\/\-\.]+)"),
        ("VILLAGE", 0.82, r"(?:गाँव|ग्राम|गांव|मौजे)\s*[:\-]?\s*([A-Za-zऀ-ॿ][A-Za-zऀ-ॿ\s]{1,30})"),
        ("TEHSIL", 0.82, r"(?:तहसील|तालुका)\s*[:\-]?\s*([A-Za-zऀ-ॿ][A-Za-zऀ-ॿ\s]{1,30})"),
        ("DISTRICT", 0.82, r"(?:जिला|जिल्हा)\s*[:\-]?\s*([A-Za-zऀ-ॿ][A-Za-zऀ-ॿ\s]{1,30})"),
        ("OWNER_NAME", 0.78, r"(?:मालिक\s*का\s*नाम|खातेदार\s*का\s*नाम|भूमिस्वामी|मालिक|खातेदार|नाव)\s*[:\-]?\s*([A-Za-zऀ-ॿ][A-Za-zऀ-ॿ\s\.]{2,59})"),
        ("AREA", 0.85, r"(?:क्षेत्रफल|क्षेत्र)\s*[:\-]?\s*([0-9०-९\.\s]+(?:\s*(?:हेक्टेयर|हेक्टयर|एकड़|वर्ग\s*मीटर))?)"),
    ],
    "ta": [
        ("SURVEY_NUMBER", 0.90, r"(?:பட்டா\s*எண்|பட்டா|புல\s*எண்|சர்வே\s*எண்)\s*[:\-]?\s*([0-9A-Za-z\/\-\.]+)"),
        ("OWNER_NAME", 0.80, r"(?:உரிமையாளர்\s*பெயர்|பெயர்|பட்டாதாரர்)\s*[:\-]?\s*([஀-௿\s\.]{2,50})"),
        ("VILLAGE", 0.82, r"(?:கிராமம்|ஊர்)\s*[:\-]?\s*([஀-௿\s]{2,30})"),
        ("TEHSIL", 0.82, r"(?:வட்டம்|தாலுகா)\s*[:\-]?\s*([஀-௿\s]{2,30})"),
        ("TEHSIL", 0.82, r"(?:மாவட்டம்)\s*[:\-]?\s*([஀-௿\s]{2,30})"),
        ("AREA", 0.85, r"(?:பரப்பளவு|விஸ்தீரணம்)\s*[:\-]?\s*([0-9\.\s]+(?:\s*(?:ஹெக்டேர்|ஏக்கர்|சதுர\s*மீட்டர்))?)"),
    ],
    "te": [
        ("SURVEY_NUMBER", 0.90, r"(?:సర్వే\s*నంబర్|సర్వే\s*నం\.?|ఖాతా\s*సంఖ్య|ఖాతా)\s*[:\-]?\s*([0-9A-Za-z\/\-\.]+)"),
        ("OWNER_NAME", 0.80, r"(?:పట్టాదారు\s*పేరు|భూమిహక్కుదారు|పేరు)\s*[:\-]?\s*([ఀ-౿\s\.]{2,50})"),
        ("VILLAGE", 0.82, r"(?:గ్రామం)\s*[:\-]?\s*([ఀ-౿\s]{2,30})"),
        ("TEHSIL", 0.82, r"(?:మండలం)\s*[:\-]?\s*([ఀ-౿\s]{2,30})"),
        ("DISTRICT", 0.82, r"(?:జిల్లా)\s*[:\-]?\s*([ఀ-౿\s]{2,30})"),
    ],
    "kn": [
        ("SURVEY_NUMBER", 0.90, r"(?:ಸರ್ವೇ\s*ನಂಬರ್|ಖಾತಾ\s*ಸಂಖ್ಯೆ|ಹಿಸ್ಸಾ\s*ನಂಬರ್)\s*[:\-]?\s*([0-9A-Za-z\/\-\.]+)"),
        ("OWNER_NAME", 0.80, r"(?:ಮಾಲೀಕರ\s*ಹೆಸರು|ಖಾತೆದಾರರ\s*ಹೆಸರು|ಹೆಸರು)\s*[:\-]?\s*([ಀ-೿\s\.]{2,50})"),
        ("VILLAGE", 0.82, r"(?:ಗ್ರಾಮ)\s*[:\-]?\s*([ಀ-೿\s]{2,30})"),
        ("TEHSIL", 0.82, r"(?:ತಾಲೂಕು)\s*[:\-]?\s*([ಀ-೿\s]{2,30})"),
        ("DISTRICT", 0.82, r"(?:ಜಿಲ್ಲೆ)\s*[:\-]?\s*([ಀ-೿\s]{2,30})"),
    ],
    "gu": [
        ("SURVEY_NUMBER", 0.90, r"(?:સર્વે\s*નંબર|ખાતા\s*નંબર|બ્લોક\s*નંબર)\s*[:\-]?\s*([0-9૦-૯A-Za-z\/\-\.]+)"),
        ("OWNER_NAME", 0.80, r"(?:ખાતેદારનું\s*નામ|જમીન\s*માલિક|નામ)\s*[:\-]?\s*([઀-૿\s\.]{2,50})"),
        ("VILLAGE", 0.82, r"(?:ગામ)\s*[:\-]?\s*([઀-૿\s]{2,30})"),
        ("TEHSIL", 0.82, r"(?:તાલુકો)\s*[:\-]?\s*([઀-૿\s]{2,30})"),
        ("DISTRICT", 0.82, r"(?:જિલ્લો)\s*[:\-]?\s*([઀-૿\s]{2,30})"),
        ("AREA", 0.85, r"(?:ક્ષેત્રફળ|વિસ્તાર)\s*[:\-]?\s*([0-9૦-૯\.\s]+(?:\s*(?:હેક્ટર|હે|વીઘા|ચો\.મી\.))?)"),
    ],
    "bn": [
        ("SURVEY_NUMBER", 0.90, r"(?:খতিয়ান\s*নং|খতিয়ান|দাগ\s*নং|দাগ)\s*[:\-]?\s*([0-9০-৯A-Za-z\/\-\.]+)"),
        ("OWNER_NAME", 0.80, r"(?:মালিকের\s*নাম|রায়তের\s*নাম|নাম)\s*[:\-]?\s*([ঀ-৿\s\.]{2,50})"),
        ("VILLAGE", 0.82, r"(?:মৌজা|গ্রাম)\s*[:\-]?\s*([ঀ-৿\s]{2,30})"),
        (None, 0.82, r"(?:থানা|মহকুমা)\s*[:\-]?\s*([ঀ-৿\s]{2,30})"),
        ("DISTRICT", 0.82, r"(?:জেলা)\s*[:\-]?\s*([ঀ-৿\s]{2,30})"),
        ("AREA", 0.85, r"(?:জমির\s*পরিমাণ|কালি)\s*[:\-]?\s*([0-9০-৯\.\s]+(?:\s*(?:একর|শতক|হেক্টর|বিঘা))?)"),
    ],
    "pa": [
        ("KHASRA_NUMBER", 0.90, r"(?:ਖਸਰਾ\s*ਨੰਬਰ|ਖੇਵਟ\s*ਨੰਬਰ|ਖਤੌਨੀ)\s*[:\-]?\s*([0-9੦-੯A-Za-z\/\-\.]+)"),
        ("OWNER_NAME", 0.80, r"(?:ਮਾਲਕ\s*ਦਾ\s*ਨਾਂ|ਨਾਮ)\s*[:\-]?\s*([਀-੿\s\.]{2,50})"),
        ("VILLAGE", 0.82, r"(?:ਪਿੰਡ)\s*[:\-]?\s*([਀-੿\s]{2,30})"),
        ("TEHSIL", 0.82, r"(?:ਤਹਿਸੀਲ)\s*[:\-]?\s*([਀-੿\s]{2,30})"),
        ("DISTRICT", 0.82, r"(?:ਜ਼ਿਲ੍ਹਾ)\s*[:\-]?\s*([਀-੿\s]{2,30})"),
        ("AREA", 0.85, r"(?:ਰਕਬਾ)\s*[:\-]?\s*([0-9੦-੯\.\s]+(?:\s*(?:ਕਨਾਲ|ਮਰਲੇ|ਏਕੜ|ਹੈਕਟੇਅਰ))?)"),
    ],
    "ml": [
        ("SURVEY_NUMBER", 0.90, r"(?:സർവേ\s*നമ്പർ|സർവേ\s*നം\.?)\s*[:\-]?\s*([0-9A-Za-z\/\-\.]+)"),
        ("OWNER_NAME", 0.80, r"(?:ഉടമസ്ഥന്റെ\s*പേര്|ഉടമസ്ഥൻ|പേര്)\s*[:\-]?\s*([ഀ-ൿ\s\.]{2,50})"),
        ("VILLAGE", 0.82, r"(?:വില്ലേജ്)\s*[:\-]?\s*([ഀ-ൿ\s]{2,30})"),
        ("TEHSIL", 0.82, r"(?:താലൂക്ക്)\s*[:\-]?\s*([ഀ-ൿ\s]{2,30})"),
        ("DISTRICT", 0.82, r"(?:ജില്ല)\s*[:\-]?\s*([ഀ-ൿ\s]{2,30})"),
        ("AREA", 0.85, r"(?:വിസ്തീർണം|വിസ്തൃതി)\s*[:\-]?\s*([0-9\.\s]+(?:\s*(?:ഹെക്ടർ|ഏക്കർ|സെന്റ്))?)"),
    ],
    "or": [
        ("KHATA_NUMBER", 0.90, r"(?:ଖାତା\s*ନଂ|ଖାତା\s*ନମ୍ବର|ଜମି\s*ଖାତା)\s*[:\-]?\s*([0-9୦-୯A-Za-z\/\-\.]+)"),
        ("PLOT_NUMBER", 0.90, r"(?:ପ୍ଲଟ\s*ନଂ|ପ୍ଲଟ\s*ନମ୍ବର)\s*[:\-]?\s*([0-9୦-୯A-Za-z\/\-\.]+)"),
        ("OWNER_NAME", 0.80, r"(?:ମାଲିକଙ୍କ\s*ନାମ|ଜମି\s*ମାଲିକ|ରୟତ\s*ନାମ|ନାମ)\s*[:\-]?\s*([଀-୿\s\.]{2,50})"),
        (None, 0.82, r"(?:ମୌଜା)\s*[:\-]?\s*([଀-୿\s]{2,30})"),
        ("TEHSIL", 0.82, r"(?:ତହସିଲ)\s*[:\-]?\s*([଀-୿\s]{2,30})"),
        ("DISTRICT", 0.82, r"(?:ଜିଲ୍ଲା)\s*[:\-]?\s*([଀-୿\s]{2,30})"),
    ],
    "mr": [
        ("SURVEY_NUMBER", 0.92, r"(?:सर्व्हे\s*नं\.?|सर्वे\s*नं\.?|सर्वे\s*नंबर|सर्वे|गट\s*क्रमांक|गट\s*नं\.?|गट\s*क्र\.?|भूमापन\s*क्रमांक|भू\.?\s*क्र\.?)\s*[:\/\s\-]*([0-9०-९A-Za-z][0-9०-९A-Za-z\/\-\.]*)"),
        ("KHATA_NUMBER", 0.90, r"(?:खाते\s*क्रमांक|खाते\s*नं\.?|खाते\s*क्र\.?|खाता\s*नं\.?|खाते)\s*[:\/\s\-]*([0-9०-९A-Za-z][0-9०-९A-Za-z\/\-\.]*)"),
        ("VILLAGE", 0.85, r"(?:गाव|मौजे|ग्राम)\s*[:\-]?\s*([A-Za-zऀ-ॿ][A-Za-zऀ-ॿ\s]{1,30})(?=\s+तालुका|\s+जिल्हा|[\n,.]|$)"),
        ("TEHSIL", 0.85, r"(?:तालुका|त\.?\s*q\.?)\s*[:\-]?\s*([A-Za-zऀ-ॿ][A-Za-zऀ-ॿ\s]{1,30})(?=\s+जिल्हा|[\n,.]|$)"),
        ("DISTRICT", 0.85, r"(?:जिल्हा|जिला)\s*[:\-]?\s*([A-Za-zऀ-ॿ][A-Za-zऀ-ॿ\s]{1,30})(?=[\n,.]|$)"),
        ("OWNER_NAME", 0.80, r"(?:खातेदाराचे\s*नाव\s*व\s*पत्ता|भोगवटदाराचे\s*नाव|खातेदाराचे\s*नाव|मालकाचे\s*नाव|भोगवटदार|मातब्बर|खातेदार)\s*[:\-]?\s*([A-Za-zऀ-ॿ][A-Za-zऀ-ॿ\s\.]{2,59})"),
        ("FATHER_NAME", 0.75, r"(?:वडिलांचे\s*नाव|पतीचे\s*नाव|पिता/पतीचे\s*नाव|पि\.\s*नाव|स/ओ)\s*[:\-]?\s*([A-Za-zऀ-ॿ][A-Za-zऀ-ॿ\s\.]{2,59})"),
        ("AREA", 0.85, r"(?:क्षेत्रफल|क्षेत्र|आकारणी)\s*[:\-]?\s*([0-9०-९]+(?:\.[0-9०-९]+)*(?:\s*(?:हेक्टर|हे|आर|चौ\.मी\.|एकड|रुपये))?)"),
        (None, 0.75, r"(?:जिरायत|बागायत|तुकडी|शेती|कृषि|बिनशेती|अकृषि)\s*[:\-]?\s*([A-Za-zऀ-ॿ]{2,20})"),
        ("MUTATION_NUMBER", 0.85, r"(?:फेरफार\s*क्रमांक|फेरफार\s*नं\.?|फेरफार)\s*[:\-]?\s*([0-9०-९A-Za-z][0-9०-९A-Za-z\/\-\.]*)"),
        ("DATE", 0.88, r"(?:दिनांक|तारीख)\s*[:\-]?\s*([0-9०-९]{1,2}[\-/\.][0-9०-९]{1,2}[\-/\.][0-9०-९]{2,4})"),
    ],
}


# The Latin spelling (ITRANS) of the letters that the nine blocks from
# Devanagari to Malayalam have at the same places.

#: Independent vowels, by their place in a block, and the signs that stand for them after a consonant.
VOWELS = {0x05: "a", 0x06: "A", 0x07: "i", 0x08: "I", 0x09: "u", 0x0A: "U", 0x0B: "RRi", 0x0C: "LLi", 0x0D: "e", 0x0E: "e", 0x0F: "e", 0x10: "ai", 0x11: "o", 0x12: "o", 0x13: "o", 0x14: "au", 0x60: "RRI", 0x61: "LLI"}
VOWEL_SIGNS = {0x3E: "A", 0x3F: "i", 0x40: "I", 0x41: "u", 0x42: "U", 0x43: "RRi", 0x44: "RRI", 0x45: "e", 0x46: "e", 0x47: "e", 0x48: "ai", 0x49: "o", 0x4A: "o", 0x4B: "o", 0x4C: "au", 0x57: "au", 0x62: "LLi", 0x63: "LLI"}
CONSONANTS = {
    0x15: "k", 0x16: "kh", 0x17: "g", 0x18: "gh", 0x19: "~N", 0x1A: "ch", 0x1B: "Ch", 0x1C: "j", 0x1D: "jh", 0x1E: "~n",
    0x1F: "T", 0x20: "Th", 0x21: "D", 0x22: "Dh", 0x23: "N", 0x24: "t", 0x25: "th", 0x26: "d", 0x27: "dh", 0x28: "n", 0x29: "n",
    0x2A: "p", 0x2B: "ph", 0x2C: "b", 0x2D: "bh", 0x2E: "m", 0x2F: "y", 0x30: "r", 0x31: "R", 0x32: "l", 0x33: "L", 0x34: "zh", 0x35: "v", 0x36: "sh", 0x37: "Sh", 0x38: "s", 0x39: "h",
    0x58: "q", 0x59: "K", 0x5A: "G", 0x5B: "z", 0x5C: ".D", 0x5D: ".Dh", 0x5E: "f", 0x5F: "Y",
}
#: Consonants with a dot below, by the place of the one without.
DOTTED = {0x15: 0x58, 0x16: 0x59, 0x17: 0x5A, 0x1C: 0x5B, 0x21: 0x5C, 0x22: 0x5D, 0x2B: 0x5E, 0x2F: 0x5F}
MARKS = {0x01: ".N", 0x02: "M", 0x03: "H", 0x3D: ".a", 0x50: "OM", 0x64: "|", 0x65: "||", 0x70: "M"}
DOT_BELOW, VIRAMA = 0x3C, 0x4D
