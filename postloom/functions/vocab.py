"""Word lists, patterns and constants that results depend on."""

from __future__ import annotations

# They must be exactly these for results to be right, so they stand here as plain text.

FILTER_RULES = [
    (r"\bпромокод\b", "promocode"),
    (r"\bpromo\s*code\b", "promocode"),
    (r"\bскидк[аиуе]\b", "discount"),
    (r"\bdiscount\b", "discount"),
    (r"подпиши(тесь|сь)\s+на\s+(наш|мой|канал)", "subscribe_cta"),
    (r"subscribe\s+to\s+(our|my|the)\s+channel", "subscribe_cta"),
    (r"\bреклама\b", "ad_label"),
    (r"#\s*реклама\b", "ad_label"),
    (r"\berid\b", "ad_label"),
    (r"партн[её]рский\s+материал", "sponsored"),
    (r"\bsponsored\b", "sponsored"),
    (r"только\s+сегодня[!.,]?", "urgency_promo"),
    (r"успей\s+купить", "urgency_promo"),
    (r"бесплатный\s+вебинар", "webinar_spam"),
    (r"заработ[ао]к\s+без\s+вложений", "scam"),
    (r"казино|ставк[аи]|букмекер", "gambling"),
    (r"t\.me/\+", "invite_link"),
    (r"https?://t\.me/\+", "invite_link"),
]
AD = r"(промокод|скидка\s*\d|подписывай|реклама|giveaway|promo\s*code|affiliate|купить\s+сейчас|order\s+now)"
AD_MARKERS = r"(промокод|скидка\s*\d|подписывай|реклама|giveaway|promo\s*code|discount\s*\d|купить\s+сейчас|order\s+now|affiliate)"
TOPIC_ENTITIES = (
    r"\b(OpenAI|ChatGPT|GPT-?\d*|Claude|Gemini|NVIDIA|Apple|iPhone(?:\s*\d+\s*Pro)?|Google|Microsoft|Cursor|Windows|Linux|Tesla|Meta|Amazon|Intel|AMD|Docker|"
    r"Kubernetes|Steam(?:\s*Machine)?|Burger\s*King)\b"
)
IMPORTANT_WORDS = ["breaking", "срочно", "запуск", "release", "acquired", "ipo", "breach", "уязвим", "nvidia", "openai", "apple", "google", "microsoft", "ai", "llm"]
THEMES = ["work", "technology", "tools", "gaming", "software", "business", "science", "politics", "other"]
THEME_RULES = [
    (
        r"(?<![a-zа-я])(ваканси\w*|удалёнк\w*|удаленк\w*|релокац\w*|зарплат\w*|job\s*offer|hiring|карьера\w*|собеседован\w*|hr\b|резюме\b|work\s*from\s*home|remote\s*work|layoff\w*|увольнен\w*)",
        "work",
    ),
    (
        r"(?<![a-zа-я])(steam\s*deck|steam\s*machine|xbox|playstation|nintendo|esport\w*|киберспорт\w*|dota|cs2|valorant|gaming|гейминг|видеоигр\w*|компьютерн\w*\s+игр\w*|game\s*pass)",
        "gaming",
    ),
    (
        r"(?<![a-zа-я])(политик\w*|politics|president\w*|президент\w*|санкци\w*|sanction\w*|trump|путин\w*|правительств\w*|парламент\w*|госдум\w*|выбор\w*|election\w*|minister\w*|министр\w*|дипломат\w*|кремл\w*|"
        r"white\s*house|нато\b|nato\b|военн\w*|войн\w*|пво\b|беспилотник\w*|drone\w*|missile\w*|ракет\w*|геополитик\w*)",
        "politics",
    ),
    (
        r"(?<![a-zа-я])(chatgpt|openai|anthropic|claude|gemini|deepseek|llm|gpt-?\d|нейросет\w*|machine\s*learning|генеративн\w*|artificial\s*intelligence|ai(?![a-zа-я])|ии(?![а-я])|vscode|cursor\b|github|gitlab|"
        r"утилита\w*|cli\b|плагин\w*|plugin\w*|extension\w*|инструмент\w*|devtools|jetbrains|figma)",
        "tools",
    ),
    (
        r"(?<![a-zа-я])(iphone|ipad|pixel|galaxy|samsung|xiaomi|huawei|oneplus|fold|flip|smartphone|смартфон\w*|планшет\w*|tablet|airpods|android|ios\b|wearable|приложение\w*|app\s*store|google\s*play|saas|macos|windows|linux|"
        r"сторонн\w*\s+приложение|software|софт\b)",
        "software",
    ),
    (
        r"(?<![a-zа-я])(кибербезопасност\w*|взлом\w*|уязвим\w*|хакер\w*|ransomware|phishing|malware|cve-|data\s*breach|утечк[аи]\s+данн\w*|vpn\b|nvidia|amd\b|intel|gpu|cpu|чип\w*|macbook|gadget|гаджет\w*|"
        r"hardware|technology|технолог\w*|laptop|ноутбук|kubernetes|docker)",
        "technology",
    ),
    (
        r"(?<![a-zа-я])(space|космос\w*|nasa|spacex|rocket|спутник\w*|марс\b|astronomy|телескоп\w*|science|наук\w*|исследован\w*|research|физик\w*|хими\w*|биолог\w*|климат\w*|атомн\w*\s+реактор|health|здоров\w*|медицин\w*|vaccine|вакцин\w*)",
        "science",
    ),
    (
        r"(?<![a-zа-я])(startup\w*|funding|инвестиц\w*|ipo\b|акци[яи]|выручк\w*|revenue|экономик\w*|банк\w*|финтех\w*|bitcoin|ethereum|crypto|крипто\w*|блокчейн\w*|blockchain|nft|binance)",
        "business",
    ),
]
FOOTER_LINES = [r"^\s*[▪•·●].*$", r"^\s*канал\s+.+\s+в\s+[«\"].*[»\"].*$", r"^\s*приложение\s+\S+\s+для\s+(ios|android).*$", r"^\s*(подписывайтесь|подписаться|читайте\s+также).*$"]
THEME_ALIASES = {
    "AI": "software", "Software": "software", "Technology": "technology", "Hardware": "technology", "Science": "science", "Business": "business", "Crypto": "business", "Sports": "other", "Sport": "other",
    "Security": "technology", "Gaming": "gaming", "Entertainment": "other", "Politics": "politics", "Health": "science", "Other": "other", "General": "other", "Work": "work", "Tools": "tools", "Mobile": "software",
    "ai_software": "software", "mobile": "software", "science_space": "science", "business_finance": "business", "crypto": "business", "sport": "other", "security": "technology", "media": "other", "Tech": "technology",
    "ИИ": "software", "Политика": "politics", "Politics & Society": "politics", "Другое": "other", "Разное": "other", "Misc": "other", "Unknown": "other", "Работа": "work", "Инструменты": "tools", "Софт": "software",
    "Бизнес": "business", "Наука": "science", "Игры": "gaming", "Технологии": "technology",
}
MERGE_STOP = [
    "что", "как", "это", "для", "или", "the", "and", "for", "with", "будет", "были", "новый", "новые", "новости", "добавят", "появятся", "рамках", "всех", "кто", "купит", "вместо", "передают", "источники", "эксклюзив",
]
MERGE_SUFFIXES = ["ами", "ями", "ов", "ей", "ах", "ях", "ом", "ем", "ый", "ая", "ое", "ые", "ии", "ий", "ую", "ой"]
SIMILARITY_STOP = ["что", "как", "это", "для", "или", "the", "and", "for", "with", "будет", "были", "новый", "новые", "новости"]
SIMILARITY_SUFFIXES = ["ами", "ями", "ов", "ей", "ах", "ях", "ом", "ем", "ый", "ая", "ое", "ые"]
STEM_VOWELS = "аеиоуыяю"
REMOVAL_WORDS = ["удал", "убрал", "исчез", "unavailable", "removed", "banned", "delete", "запрет", "недоступ"]
STORE_WORDS = ["google", "play", "store", "магазин", "app store"]
BLOCKED_CHANNELS = ["joinchat", "addstickers", "share", "proxy", "socks", "iv"]
BRANDS = {
    "ps5": "PS5", "ps4": "PS4", "xbox": "Xbox", "iphone": "iPhone", "ipad": "iPad", "ios": "iOS", "macos": "macOS", "gpt": "GPT", "chatgpt": "ChatGPT", "openai": "OpenAI", "nvidia": "NVIDIA", "amd": "AMD", "ai": "AI",
    "api": "API", "cpu": "CPU", "gpu": "GPU", "usb": "USB", "vr": "VR", "ar": "AR", "llm": "LLM", "steam": "Steam", "youtube": "YouTube", "github": "GitHub", "linkedin": "LinkedIn", "tiktok": "TikTok", "whatsapp": "WhatsApp",
}
DAY_WORDS = [
    (r"\bпослезавтра\b", 2), (r"\bday\s+after\s+tomorrow\b", 2), (r"\bпозавчера\b", -2), (r"\bзавтра\b", 1), (r"\btomorrow\b", 1), (r"\bвчера\b", -1), (r"\byesterday\b", -1), (r"\bсегодня\b", 0), (r"\btoday\b", 0),
]
DAY_COUNTS = {"один": 1, "одну": 1, "два": 2, "две": 2, "три": 3, "четыре": 4, "пять": 5, "шесть": 6, "семь": 7}
INTENT_QA = r"\b(почему|зачем|как\s+так|what\s+happened|why|how\s+come|объясн|разбер)\b"
INTENT_RECOMMEND = r"\b(лучш|топ|рекоменд|best|top|для\s+блогеров|which\s+should)\b"
INTENT_NEWS = r"\b(что\s+нового|новост|news|updates?|что\s+извс|latest)\b"
INTENT_TIMELINE = r"\b(вчера|сегодня|хронолог|timeline|история\s+событ|за\s+24|last\s+24|недел[еиюя]|месяц|week|month|today|yesterday)\b"
INTENT_ALL = r"\b(все\s+новост|all\s+news|everything\s+about)\b"
PERIODS = [(r"\b(сегодня|today|heute|hoy|сутки|24\s*h)\b", 1), (r"\b(недел[еиюя]|week|woche|semana)\b", 7), (r"\b(месяц[аеу]?|month|monat|mes)\b", 30)]
ALIASES = [
    ("apple", "Apple", "Company"), ("эппл", "Apple", "Company"), ("google", "Google", "Company"), ("гугл", "Google", "Company"), ("microsoft", "Microsoft", "Company"), ("майкрософт", "Microsoft", "Company"),
    ("openai", "OpenAI", "Company"), ("open ai", "OpenAI", "Company"), ("опенаи", "OpenAI", "Company"), ("anthropic", "Anthropic", "Company"), ("nvidia", "NVIDIA", "Company"), ("нвидиа", "NVIDIA", "Company"),
    ("valve", "Valve", "Company"), ("samsung", "Samsung", "Company"), ("самсунг", "Samsung", "Company"), ("meta", "Meta", "Company"), ("tesla", "Tesla", "Company"), ("amazon", "Amazon", "Company"), ("intel", "Intel", "Company"),
    ("amd", "AMD", "Company"), ("tim cook", "Tim Cook", "Person"), ("sam altman", "Sam Altman", "Person"), ("сэм альтман", "Sam Altman", "Person"), ("jensen huang", "Jensen Huang", "Person"), ("elon musk", "Elon Musk", "Person"),
    ("илон маск", "Elon Musk", "Person"), ("iphone", "iPhone", "Product"), ("айфон", "iPhone", "Product"), ("iphone 18", "iPhone 18", "Product"), ("iphone 18 pro", "iPhone 18 Pro", "Product"), ("айфон 18", "iPhone 18", "Product"),
    ("айфон 18 pro", "iPhone 18 Pro", "Product"), ("macbook", "MacBook", "Product"), ("макбук", "MacBook", "Product"), ("chatgpt", "ChatGPT", "Product"), ("чатгпт", "ChatGPT", "Product"), ("chat gpt", "ChatGPT", "Product"),
    ("claude", "Claude", "Product"), ("gemini", "Gemini", "Product"), ("cursor", "Cursor", "Product"), ("курсор", "Cursor", "Product"), ("steam machine", "Steam Machine", "Product"), ("steam deck", "Steam Deck", "Product"),
    ("стим дек", "Steam Deck", "Product"), ("vision pro", "Vision Pro", "Product"), ("apple intelligence", "Apple Intelligence", "Product"), ("a20 pro", "A20 Pro", "Product"), ("rtx", "RTX", "Product"), ("llm", "LLM", "Technology"),
    ("ai", "AI", "Technology"), ("ии", "AI", "Technology"), ("нейросети", "AI", "Technology"), ("нейросеть", "AI", "Technology"), ("artificial intelligence", "AI", "Technology"), ("cuda", "CUDA", "Technology"),
    ("python", "Python", "Technology"), ("ray tracing", "Ray Tracing", "Technology"), ("diffusion", "Diffusion", "Technology"), ("gaming", "Gaming", "Topic"), ("гейминг", "Gaming", "Topic"), ("cybersecurity", "Cybersecurity", "Topic"),
    ("programming", "Programming", "Topic"), ("программирование", "Programming", "Topic"), ("usa", "USA", "Country"), ("сша", "USA", "Country"), ("germany", "Germany", "Country"), ("japan", "Japan", "Country"), ("china", "China", "Country"),
    ("китай", "China", "Country"), ("russia", "Russia", "Country"), ("россия", "Russia", "Country"), ("nasa", "NASA", "Organization"), ("eu", "EU", "Organization"),
]
SEED_EDGES = [
    ("Apple", "iPhone", "CREATED"), ("Apple", "MacBook", "CREATED"), ("Apple", "Vision Pro", "CREATED"), ("Apple", "Apple Intelligence", "CREATED"), ("Apple", "A20 Pro", "PRODUCES"), ("Apple", "AI", "RELATED_TO"),
    ("OpenAI", "ChatGPT", "CREATED"), ("OpenAI", "AI", "RELATED_TO"), ("Anthropic", "Claude", "CREATED"), ("Google", "Gemini", "CREATED"), ("Google", "AI", "RELATED_TO"), ("NVIDIA", "CUDA", "CREATED"), ("NVIDIA", "RTX", "PRODUCES"),
    ("NVIDIA", "AI", "RELATED_TO"), ("Valve", "Steam Machine", "CREATED"), ("Valve", "Steam Deck", "CREATED"), ("Valve", "Gaming", "RELATED_TO"), ("iPhone", "Apple", "PART_OF"), ("iPhone 18 Pro", "iPhone", "SUCCESSOR_OF"),
    ("iPhone 18", "iPhone", "SUCCESSOR_OF"), ("iPhone 18 Pro", "Apple", "PART_OF"), ("ChatGPT", "OpenAI", "PART_OF"), ("Claude", "Anthropic", "PART_OF"), ("Cursor", "AI", "USES"), ("Cursor", "Programming", "RELATED_TO"),
    ("Sam Altman", "OpenAI", "WORKS_AT"), ("Tim Cook", "Apple", "WORKS_AT"), ("Jensen Huang", "NVIDIA", "WORKS_AT"),
]
#: What a node belongs to, by its canonical name.
CATEGORIES = {
    "Apple": ["Consumer Electronics", "AI", "Mobile", "Hardware"], "Google": ["AI", "Search", "Cloud", "Software"], "Microsoft": ["Software", "AI", "Cloud"], "OpenAI": ["AI", "LLM", "Software"], "Anthropic": ["AI", "LLM"],
    "NVIDIA": ["AI", "Hardware", "GPU"], "Valve": ["Gaming", "Steam", "PC", "Linux"], "Samsung": ["Mobile", "Hardware", "Consumer Electronics"], "Meta": ["AI", "Social", "VR"], "Tesla": ["Automotive", "AI", "Hardware"],
    "Amazon": ["Cloud", "E-commerce", "AI"], "Intel": ["Hardware", "CPU"], "AMD": ["Hardware", "GPU", "CPU"], "Tim Cook": ["Apple", "Business"], "Sam Altman": ["OpenAI", "AI"], "Jensen Huang": ["NVIDIA", "AI"],
    "Elon Musk": ["Tesla", "AI"], "iPhone": ["Apple", "Mobile", "Hardware"], "iPhone 18": ["Apple", "Mobile", "Hardware"], "iPhone 18 Pro": ["Apple", "Mobile", "Hardware"], "MacBook": ["Apple", "Hardware", "Laptop"],
    "ChatGPT": ["OpenAI", "AI", "LLM"], "Claude": ["Anthropic", "AI", "LLM"], "Gemini": ["Google", "AI", "LLM"], "Cursor": ["AI", "Programming", "Software"], "Steam Machine": ["Valve", "Gaming", "PC"],
    "Steam Deck": ["Valve", "Gaming", "PC"], "Vision Pro": ["Apple", "VR", "Hardware"], "Apple Intelligence": ["Apple", "AI"], "A20 Pro": ["Apple", "Hardware", "Chip"], "RTX": ["NVIDIA", "GPU", "Hardware"], "LLM": ["AI", "Software"],
    "AI": ["Technology", "Software"], "CUDA": ["NVIDIA", "GPU"], "Python": ["Programming", "Software"], "Ray Tracing": ["Graphics", "GPU"], "Diffusion": ["AI", "Image"], "Gaming": ["Entertainment", "PC"],
    "Cybersecurity": ["Security", "Software"], "Programming": ["Software", "Development"], "USA": ["Geography"], "Germany": ["Geography"], "Japan": ["Geography"], "China": ["Geography"], "Russia": ["Geography"],
    "NASA": ["Space", "Science"], "EU": ["Politics"],
}
SEARCH_STOP = [
    "что", "как", "про", "для", "или", "это", "было", "были", "новые", "новости", "the", "and", "for", "with", "what", "about", "new", "news", "week", "month", "сегодня", "неделя", "неделю", "месяц", "месяца", "за", "по", "с",
    "лучш", "лучшие", "нейросети", "happened", "neuen", "nuevo", "почему", "why",
]
STAGES = [("queued", 0), ("connect", 5), ("fetch", 25), ("clean", 10), ("dedupe", 5), ("ai", 40), ("relations", 10), ("save", 5), ("done", 100)]
BACKFILL_LIMITS = {1: 200, 2: 400, 7: 800, 14: 1200, 30: 2000}
# End of the fixed values.

#: What a search hit says about itself (fixed values).
WHY = {"node": "связано с ", "graph": "найдено через Knowledge Graph", "sources": ("подтверждено ", " источниками"), "fresh": "опубликовано недавно", "important": "высокая важность", "deep": "уточнено Deep Search"}
ANSWER_HEAD, ANSWER_EMPTY = ("По запросу «", "»:"), "По вашему запросу релевантных новостей найдено не было."
