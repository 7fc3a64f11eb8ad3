"""Readings that results depend on. Longer dictionaries are parameters of the functions that use them."""

# Fixed values
HUNDREDS = ["", "сто", "двести", "триста", "четыреста", "пятьсот", "шестьсот", "семьсот", "восемьсот", "девятьсот"]
TENS = ["", "", "двадцать", "тридцать", "сорок", "пятьдесят", "шестьдесят", "семьдесят", "восемьдесят", "девяносто"]
ONES = [
    "", "один", "два", "три", "четыре", "пять", "шесть", "семь", "восемь", "девять", "десять", "одиннадцать", "двенадцать", "тринадцать",
    "четырнадцать", "пятнадцать", "шестнадцать", "семнадцать", "восемнадцать", "девятнадцать",
]
ONES_FEMININE = ["", "одна", "две", *ONES[3:]]
DIGITS = ["ноль", *ONES[1:10]]
THOUSAND, MILLION, BILLION = ("тысяча", "тысячи", "тысяч"), ("миллион", "миллиона", "миллионов"), ("миллиард", "миллиарда", "миллиардов")
ORDINAL_GENITIVE = [
    "", "первого", "второго", "третьего", "четвёртого", "пятого", "шестого", "седьмого", "восьмого", "девятого", "десятого",
    "одиннадцатого", "двенадцатого", "тринадцатого", "четырнадцатого", "пятнадцатого", "шестнадцатого", "семнадцатого",
    "восемнадцатого", "девятнадцатого",
]
TENS_ORDINAL = ["", "", "двадцат", "тридцат", "сороков", "пятидесят", "шестидесят", "семидесят", "восьмидесят", "девяност"]
HUNDREDS_ORDINAL = ["", "сот", "двухсот", "трёхсот", "четырёхсот", "пятисот", "шестисот", "семисот", "восьмисот", "девятисот"]
DAYS = [
    "", "первое", "второе", "третее", "четвёртое", "пятое", "шестое", "седьмое", "восьмое", "девятое", "десятое", "одиннадцатое",
    "двенадцатое", "тринадцатое", "четырнадцатое", "пятнадцатое", "шестнадцатое", "семнадцатое", "восемнадцатое", "девятнадцатое",
    "двадцатое", "двадцать первое", "двадцать второе", "двадцать третее", "двадцать четвёртое", "двадцать пятое", "двадцать шестое",
    "двадцать седьмое", "двадцать восьмое", "двадцать девятое", "тридцатое", "тридцать первое",
]
LIST_ORDINALS = ["", "первое", "второе", "третье", "четвёртое", "пятое", "шестое", "седьмое", "восьмое", "девятое", "десятое"]
MONTHS = ["", "января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря"]
HOURS, MINUTES, SECONDS, PERCENT = ("час", "часа", "часов"), ("минута", "минуты", "минут"), ("секунда", "секунды", "секунд"), ("процент", "процента", "процентов")
GENITIVE = {
    "одиннадцать": "одиннадцати", "двенадцать": "двенадцати", "тринадцать": "тринадцати", "четырнадцать": "четырнадцати",
    "пятнадцать": "пятнадцати", "шестнадцать": "шестнадцати", "семнадцать": "семнадцати", "восемнадцать": "восемнадцати",
    "девятнадцать": "девятнадцати", "восемьдесят": "восьмидесяти", "пятьдесят": "пятидесяти", "шестьдесят": "шестидесяти",
    "семьдесят": "семидесяти", "двадцать": "двадцати", "тридцать": "тридцати", "девяносто": "девяноста", "четыреста": "четырёхсот",
    "двести": "двухсот", "триста": "трёхсот", "пятьсот": "пятисот", "шестьсот": "шестисот", "семьсот": "семисот",
    "восемьсот": "восьмисот", "девятьсот": "девятисот", "четыре": "четырёх", "сорок": "сорока", "сто": "ста", "одна": "одной",
    "один": "одного", "две": "двух", "два": "двух", "три": "трёх", "пять": "пяти", "шесть": "шести", "семь": "семи",
    "восемь": "восьми", "девять": "девяти", "десять": "десяти", "тысяча": "тысячи", "миллион": "миллиона",
    "миллиарда": "миллиардов", "миллиард": "миллиарда",
}
#: Unit: singular, genitive singular, genitive plural, feminine.
SIZE_UNITS = {
    "kb": ("килобайт", "килобайта", "килобайт", False), "mb": ("мегабайт", "мегабайта", "мегабайт", False),
    "gb": ("гигабайт", "гигабайта", "гигабайт", False), "tb": ("терабайт", "терабайта", "терабайт", False),
    "кб": ("килобайт", "килобайта", "килобайт", False), "мб": ("мегабайт", "мегабайта", "мегабайт", False),
    "гб": ("гигабайт", "гигабайта", "гигабайт", False), "тб": ("терабайт", "терабайта", "терабайт", False),
    "ms": ("миллисекунда", "миллисекунды", "миллисекунд", True), "sec": ("секунда", "секунды", "секунд", True),
    "min": ("минута", "минуты", "минут", True), "hr": ("час", "часа", "часов", False), "px": ("пиксель", "пикселя", "пикселей", False),
    "em": ("эм", "эм", "эм", False), "rem": ("рем", "рем", "рем", False), "vh": ("ви эйч", "ви эйч", "ви эйч", False),
    "vw": ("ви дабл ю", "ви дабл ю", "ви дабл ю", False),
}
VERSION_SUFFIXES = {"alpha": "альфа", "beta": "бета", "rc": "эр си", "dev": "дев", "stable": "стейбл", "release": "релиз"}
LETTERS = {
    "a": "эй", "b": "би", "c": "си", "d": "ди", "e": "и", "f": "эф", "g": "джи", "h": "эйч", "i": "ай", "j": "джей", "k": "кей", "l": "эл",
    "m": "эм", "n": "эн", "o": "о", "p": "пи", "q": "кью", "r": "ар", "s": "эс", "t": "ти", "u": "ю", "v": "ви", "w": "даблю", "x": "икс",
    "y": "вай", "z": "зет",
}
AS_WORD = {
    "json": "джейсон", "yaml": "ямл", "toml": "томл", "rest": "рест", "ajax": "эйджакс", "crud": "крад", "cors": "корс", "oauth": "о ауз",
    "gif": "гиф", "jpeg": "джейпег", "ram": "рам", "rom": "ром", "lan": "лан", "wan": "ван", "spa": "спа", "dom": "дом", "gui": "гуи",
    "imap": "ай мап", "pop": "поп", "devops": "девопс",
}
SPECIAL_ABBREVIATIONS = {"ios": "ай оу эс", "macos": "мак оу эс", "graphql": "граф кью эл", "iot": "ай о ти"}
TRANSLITERATION = {
    "tion": "шн", "sion": "жн", "sh": "ш", "ch": "ч", "th": "с", "ph": "ф", "wh": "в", "ck": "к", "gh": "г", "ng": "нг", "qu": "кв",
    "ee": "и", "oo": "у", "ea": "и", "ou": "ау", "ow": "оу", "ai": "эй", "ay": "эй", "ey": "эй", "ei": "эй", "ie": "и", "oa": "оу",
    "oi": "ой", "oy": "ой", "au": "о", "aw": "о", "ew": "ью", "a": "а", "b": "б", "c": "к", "d": "д", "e": "е", "f": "ф", "g": "г",
    "h": "х", "i": "и", "j": "дж", "k": "к", "l": "л", "m": "м", "n": "н", "o": "о", "p": "п", "q": "к", "r": "р", "s": "с", "t": "т",
    "u": "у", "v": "в", "w": "в", "x": "кс", "y": "и", "z": "з",
}
PROTOCOLS = {
    "https": "эйч ти ти пи эс", "http": "эйч ти ти пи", "ftp": "эф ти пи", "ssh": "эс эс эйч", "git": "гит", "file": "файл",
    "sftp": "эс эф ти пи", "ws": "веб сокет", "wss": "веб сокет секьюр",
}
TLDS = {
    "com": "ком", "org": "орг", "net": "нет", "ru": "ру", "io": "ай оу", "dev": "дев", "app": "апп", "ai": "эй ай", "co": "ко", "me": "ми",
    "uk": "ю кей", "edu": "еду", "gov": "гов", "info": "инфо", "biz": "биз",
}
OPERATORS = {
    "===": "строго равно", "!==": "строго не равно", "->": "стрелка", "=>": "толстая стрелка", ">=": "больше или равно",
    "<=": "меньше или равно", "!=": "не равно", "==": "равно равно", "&&": "и", "||": "или",
}
SYMBOLS = {
    "α": "альфа", "β": "бета", "γ": "гамма", "δ": "дельта", "ε": "эпсилон", "ζ": "дзета", "η": "эта", "θ": "тета", "ι": "йота",
    "κ": "каппа", "λ": "лямбда", "μ": "мю", "ν": "ню", "ξ": "кси", "π": "пи", "ρ": "ро", "σ": "сигма", "τ": "тау", "υ": "ипсилон",
    "φ": "фи", "χ": "хи", "ψ": "пси", "ω": "омега", "Α": "альфа", "Β": "бета", "Γ": "гамма", "Δ": "дельта", "Ε": "эпсилон",
    "Ζ": "дзета", "Η": "эта", "Θ": "тета", "Ι": "йота", "Κ": "каппа", "Λ": "лямбда", "Μ": "мю", "Ν": "ню", "Ξ": "кси", "Π": "пи",
    "Ρ": "ро", "Σ": "сигма", "Τ": "тау", "Υ": "ипсилон", "Φ": "фи", "Χ": "хи", "Ψ": "пси", "Ω": "омега", "∞": "бесконечность",
    "∈": "принадлежит", "∉": "не принадлежит", "∀": "для всех", "∃": "существует", "∅": "пустое множество", "∩": "пересечение",
    "∪": "объединение", "⊂": "подмножество", "≠": "не равно", "≈": "приблизительно равно", "≤": "меньше или равно",
    "≥": "больше или равно", "×": "умножить", "÷": "разделить", "√": "корень", "∑": "сумма", "∏": "произведение", "→": "стрелка",
    "←": "стрелка влево", "↔": "двунаправленная стрелка", "⇒": "следует", "⇐": "следует из", "⇔": "эквивалентно",
}
#: Words of prose, a part; more come as a parameter.
TERMS = {
    "php": "пи эйч пи", "sql": "эс кью эль", "html": "эйч ти эм эль", "css": "си эс эс", "xml": "икс эм эль", "json": "джейсон",
    "yaml": "ямл", "js": "джи эс", "ts": "ти эс", "async": "асинк", "await": "эвейт", "feature": "фича", "branch": "бранч",
    "merge": "мёрдж", "commit": "коммит", "deploy": "деплой", "release": "релиз", "bug": "баг", "cache": "кэш", "queue": "кью",
    "index": "индекс", "query": "квери", "docker": "докер", "client": "клиент", "test": "тест", "build": "билд", "python": "пайтон",
    "rust": "раст", "react": "риакт", "github": "гитхаб", "request": "реквест", "code": "код", "use": "юз", "case": "кейс",
    "home": "хоум", "docs": "докс", "user": "юзер", "users": "юзерс", "admin": "админ", "config": "конфиг", "data": "дата",
    "files": "файлс", "download": "даунлоад", "upload": "аплоад", "api": "эй пи ай", "app": "апп", "web": "веб", "src": "сорс",
    "pdf": "пэ дэ эф", "doc": "док", "txt": "тэкст", "csv": "си эс ви", "png": "пнг", "hello": "хеллоу", "world": "ворлд",
    "example": "экзампл", "tutorial": "тьюториал", "file": "файл", "image": "имидж", "line": "лайн", "page": "пейдж", "type": "тайп",
    "true": "тру", "false": "фолс", "null": "налл", "string": "строка", "array": "массив", "class": "класс", "function": "функция",
}
#: Words of identifiers, a part; more come as a parameter.
CODE_TERMS = {
    "get": "гет", "set": "сет", "is": "из", "has": "хэз", "add": "адд", "delete": "делит", "update": "апдейт", "find": "файнд",
    "load": "лоуд", "save": "сейв", "user": "юзер", "data": "дата", "item": "айтем", "list": "лист", "value": "вэлью", "key": "кей",
    "name": "нейм", "id": "ай ди", "type": "тайп", "size": "сайз", "count": "каунт", "index": "индекс", "error": "эррор",
    "message": "мессадж", "controller": "контроллер", "service": "сервис", "max": "макс", "min": "мин", "def": "деф", "print": "принт",
    "hello": "хелло", "world": "ворлд", "http": "эйч ти ти пи", "html": "эйч ти эм эль", "api": "эй пи ай", "url": "ю ар эл",
    "x": "икс", "y": "игрек", "z": "зет", "a": "эй", "b": "би", "i": "ай", "j": "джей", "k": "кей", "n": "эн", "m": "эм",
}
CODE_LETTERS = TRANSLITERATION | {"y": "й"}
#: Numbers that are read as such in identifiers, and in blocks of code; others go digit by digit. 1000 is a word of its own in identifiers.
CODE_NUMBERS = [*range(31), 32, 40, 42, 50, 56, 60, 64, 70, 80, 90, 100, 128, 200, 256, 512]
BLOCK_NUMBERS = [*range(31), 32, 40, 42, 50, 60, 64, 70, 80, 90, 100]
#: Signs of code.
SIGNS = {
    "<->": "двунаправленная стрелка", "===": "строго равно", "!==": "строго не равно", "...": "троеточие", "::": "двойное двоеточие",
    "->": "стрелка", "=>": "толстая стрелка", "<-": "стрелка влево", ">=": "больше или равно", "<=": "меньше или равно",
    "!=": "не равно", "==": "равно равно", "&&": "и", "||": "или", "??": "нулевое слияние", "?.": "опциональная цепочка",
    "**": "степень", "//": "целочисленное деление", "++": "плюс плюс", "--": "минус минус", "+=": "плюс равно", "-=": "минус равно",
    "*=": "умножить равно", "/=": "делить равно", ":=": "присваивание", "<<": "сдвиг влево", ">>": "сдвиг вправо", "<": "меньше",
    ">": "больше", "=": "равно", "+": "плюс", "-": "минус", "*": "умножить", "/": "делить", "%": "процент",
    "!": "восклицательный знак", "?": "вопросительный знак", "&": "амперсанд", "|": "пайп", "^": "каретка", "~": "тильда",
    ".": "точка", ",": "запятая", ":": "двоеточие", ";": "точка с запятой", "_": "нижнее подчёркивание", "\\": "бэкслэш",
    "(": "открывающая скобка", ")": "закрывающая скобка", "[": "открывающая квадратная скобка",
    "]": "закрывающая квадратная скобка", "{": "открывающая фигурная скобка", "}": "закрывающая фигурная скобка", "@": "собака",
    "#": "решётка", "$": "доллар", '"': "кавычка", "'": "апостроф", "`": "обратная кавычка", "«": "открывающая кавычка",
    "»": "закрывающая кавычка", "©": "копирайт", "®": "зарегистрировано", "™": "торговая марка", "°": "градус", "±": "плюс минус",
}
ARROWS = "→←↔⇒⇐⇔"
#: Mathematical signs that are read in blocks of code.
BLOCK_MATH = "∞∈∉∀∃≠≤≥"
#: Signs that a percent-decoded part of a URL may hold.
DECODED = {
    "/": "слэш", "?": "вопросительный знак", "#": "решётка", "&": "амперсанд", "=": "равно", ":": "двоеточие", "@": "собака",
    "(": "открывающая скобка", ")": "закрывающая скобка", ",": "запятая", ";": "точка с запятой", "'": "апостроф", '"': "кавычка",
    "<": "меньше", ">": "больше", "*": "умножить", "|": "пайп", "\\": "бэкслэш", "$": "доллар", "!": "восклицательный знак",
    "~": "тильда", "^": "каретка", "[": "открывающая квадратная скобка", "]": "закрывающая квадратная скобка",
    "{": "открывающая фигурная скобка", "}": "закрывающая фигурная скобка", "`": "обратная кавычка",
}
DRIVES = {"c": "си", "d": "ди", "e": "и", "f": "эф", "g": "джи", "h": "эйч"}
PHRASES = {
    "pull request": "пулл реквест", "merge request": "мёрдж реквест", "code review": "код ревью", "feature branch": "фича бранч",
    "stack trace": "стэк трейс", "daily standup": "дейли стендап", "hot fix": "хот фикс", "hot reload": "хот релоуд",
    "live reload": "лайв релоуд", "dry run": "драй ран", "tech debt": "тек дет", "code smell": "код смелл",
    "best practice": "бест практис", "use case": "юз кейс", "edge case": "эдж кейс",
}
LANGUAGES = {
    "python": "пайтон", "py": "пайтон", "javascript": "джаваскрипт", "js": "джаваскрипт", "typescript": "тайпскрипт", "ts": "тайпскрипт",
    "bash": "баш", "sh": "шелл", "shell": "шелл", "zsh": "зи шелл", "sql": "эс кью эл", "json": "джейсон", "yaml": "ямл", "yml": "ямл",
    "html": "эйч ти эм эл", "css": "си эс эс", "go": "го", "golang": "голанг", "rust": "раст", "java": "джава", "kotlin": "котлин",
    "swift": "свифт", "ruby": "руби", "php": "пи эйч пи", "c": "си", "cpp": "си плюс плюс", "c++": "си плюс плюс", "cs": "си шарп",
    "csharp": "си шарп", "c#": "си шарп", "markdown": "маркдаун", "md": "маркдаун", "xml": "икс эм эл", "toml": "томл",
    "dockerfile": "докерфайл", "makefile": "мейкфайл", "graphql": "граф кью эл", "scss": "эс си эс эс", "sass": "сасс", "less": "лесс",
    "vue": "вью", "jsx": "джей эс икс", "tsx": "ти эс икс", "r": "ар", "perl": "перл", "lua": "луа", "elixir": "эликсир",
    "erlang": "эрланг", "haskell": "хаскелл", "scala": "скала", "clojure": "кложур", "dart": "дарт", "nginx": "энджинкс",
    "apache": "апачи", "terraform": "терраформ", "powershell": "пауэршелл", "mermaid": "мёрмэйд",
}
# End of fixed values
