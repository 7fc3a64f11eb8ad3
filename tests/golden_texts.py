"""Texts and what they must become; the name in directives is one of our own."""

# Fixed values
GOLDEN = [
    ('abbreviation_http', 'Запрос через HTTP и HTTPS.', 'Запрос через эйч ти ти пи и эйч ти ти пи эс.'),
    ('abbreviation_upper', 'Использую JSON и XML.', 'Использую джейсон и икс эм эль.'),
    ('arrow_symbols', 'Переход A → B.', 'Переход эй  стрелка  би.'),
    ('camelcase', 'Функция getUserData принимает id.', 'Функция гет юзер дата принимает ид.'),
    ('date_dot', 'Встреча 12.05.2024 в календаре.', 'Встреча двенадцатое мая две тысячи двадцать четвёртого года в календаре.'),
    ('date_iso', 'Релиз 2024-05-12 состоялся.', 'Релиз двенадцатое мая две тысячи двадцать четвёртого года состоялся.'),
    ('duration_ms', 'Задержка 300ms.', 'Задержка триста миллисекунд.'),
    ('email', 'Пишите на user@example.com .', 'Пишите на юзер собака экзампл точка ком.'),
    ('english_single_letter', 'Переменная x равна 5.', 'Переменная икс равна пять.'),
    ('english_word_common', 'Нужно сделать download и install.', 'Нужно сделать даунлоад и инсталл.'),
    ('english_word_embedded', 'user use', 'юзер юз'),
    ('english_word_it', 'Это API и HTTP-протокол.', 'Это эй пи ай и эйч ти ти пи-протокол.'),
    ('english_word_repeated', 'user user', 'юзер юзер'),
    ('filepath_absolute', 'Файл /home/user/docs/file.pdf.', 'Файл слэш хоум слэш юзер слэш докс слэш файл точка пэ дэ эф.'),
    ('greek_letters', 'Формула α + β = γ.', 'Формула  альфа  +  бета  =  гамма .'),
    ('ip_address', 'Сервер 192.168.1.1 доступен.', 'Сервер сто девяносто два точка сто шестьдесят восемь точка один точка один доступен.'),
    ('kebab_case', 'Параметр max-width установлен.', 'Параметр макс видтх установлен.'),
    ('leading_dot_decimal', 'Вес .5 кг', 'Вес ноль точка пять кг'),
    ('markdown_code_block', "```python\ndef hello():\n    print('hi')\n```", 'деф хелло открывающая скобка закрывающая скобка двоеточие принт открывающая скобка хи закрывающая скобка'),
    ('markdown_code_block_duplicates', "<!-- voice-code: full -->\n```python\nprint('world')\n```\n<!-- voice-code: brief -->\n```python\nprint('world')\n```", 'принт открывающая скобка ворлд закрывающая скобка\n\nдалее следует пример кода на пайтон'),
    ('markdown_header', '# Заголовок\nТекст.', 'Заголовок\nТекст.'),
    ('markdown_inline_code', 'Переменная `count` больше 10.', 'Переменная каунт больше десять.'),
    ('markdown_link', 'Ссылка [GitHub](https://github.com).', 'Ссылка гит хуб.'),
    ('markdown_list_number', '1. Первое\n2. Второе\n3. Третье.', 'первое:Первое\nвторое:Второе\nтретье:Третье.'),
    ('markdown_mermaid', '```mermaid\ngraph TD\nA-->B\n```', 'Тут мермэйд диаграмма'),
    ('math_symbols', 'Условие x <= y.', 'Условие икс  меньше или равно  вай.'),
    ('mixed_paragraph', 'Установите Docker версии >= 20.10 с https://docker.com и проверьте getUserData() возвращает корректный JSON с полем user_id.', 'Установите докер версии  больше или равно  двадцать точка десять с эйч ти ти пи эс двоеточие слэш слэш докер точка ком и проверьте гет юзер дата() возвращает корректный джейсон с полем юзер ай ди.'),
    ('number_decimal', 'Скорость 3.14 метра в секунду.', 'Скорость три точка четырнадцать метра в секунду.'),
    ('number_embedded_score', 'Счёт 10:1 в нашу пользу.', 'Счёт десять:один в нашу пользу.'),
    ('number_large', 'Население 100500 человек.', 'Население сто тысяч пятьсот человек.'),
    ('number_plain', 'Было 42 яблока.', 'Было сорок два яблока.'),
    ('number_repeated', '42 42', 'сорок два сорок два'),
    ('number_sentence_dot', 'Встреча в 5.', 'Встреча в пять.'),
    ('operators', 'Код a != b && c == d.', 'Код эй  не равно  би  и  си  равно равно  ди.'),
    ('pascalcase', 'Класс UserController наследуется.', 'Класс юзер контроллер наследуется.'),
    ('percentage_decimal', 'Точность 99.5%.', 'Точность девяносто девять точка пять процентов.'),
    ('percentage_int', 'Скидка 50%.', 'Скидка пятьдесят процентов.'),
    ('quotes_dashes', 'Слово — «кавычки»\nОдин – два, “три” и ‘четыре’', 'Слово - "кавычки"\nОдин - два, "три" и \'четыре\''),
    ('range_percent', 'Рост на 10-20% за квартал', 'Рост на от десяти до двадцати процентов за квартал'),
    ('range_simple', 'Диапазон 10-20 страниц.', 'Диапазон от десяти до двадцати страниц.'),
    ('range_years', 'С 1990 по 2020 годы.', 'С одна тысяча девятьсот девяносто по две тысячи двадцать годы.'),
    ('size_gb', 'Диск на 5GB.', 'Диск на пять гигабайт.'),
    ('size_kb', 'Документ занимает 512KB.', 'Документ занимает пятьсот двенадцать килобайт.'),
    ('size_mb', 'Файл весит 100MB.', 'Файл весит сто мегабайт.'),
    ('snake_case', 'Переменная user_id теперь nullable.', 'Переменная юзер ай ди теперь нуллабле.'),
    ('tilde_approx', '~46 секунд', 'около 46 секунд'),
    ('tilde_approx_space', '~ 5 минут', 'около 5 минут'),
    ('time_hm', 'Начало в 14:30 по расписанию.', 'Начало в четырнадцать часов тридцать минут по расписанию.'),
    ('time_hms', 'Таймер 14:30:05 истёк.', 'Таймер четырнадцать часов тридцать минут пять секунд истёк.'),
    ('url_https', 'Репозиторий https://github.com/snakers4/silero-models .', 'Репозиторий эйч ти ти пи эс двоеточие слэш слэш гитхаб точка ком слэш снакерс четыре слэш силеро моделс.'),
    ('url_percent_encoding', 'Документ https://example.com/docs/%D0%BE%D1%82%D1%87%D1%91%D1%82%20%D1%84%D0%B8%D0%BD%D0%B0%D0%BB.pdf?q=hello+world готов.', 'Документ эйч ти ти пи эс двоеточие слэш слэш экзампл точка ком слэш докс слэш отчёт финал точка пэ дэ эф вопросительный знак к равно хеллоу ворлд готов.'),
    ('url_query_fragment', 'Открой https://example.com/search?q=test&lang=ru#section-2.', 'Открой эйч ти ти пи эс двоеточие слэш слэш экзампл точка ком слэш сирч вопросительный знак к равно тест ланг равно ру решётка секшн два.'),
    ('url_schemeless', 'Сайт www.example.com лёг, документация на docs.python.org/3/tutorial, а файл file.txt и версия 1.2.3 не ссылки.', 'Сайт ввв точка экзампл точка ком лёг, документация на докс точка пайтон точка орг слэш три слэш тьюториал, а файл файл.тэкст и версия один точка два точка три не ссылки.'),
    ('version_patch', 'Обновление до v2.0.1.', 'Обновление до два точка ноль точка один.'),
    ('version_prerelease', 'Сборка 1.0.0-alpha.', 'Сборка один точка ноль точка ноль альфа.'),
    ('version_semver', 'Версия v1.2.3.', 'Версия один точка два точка три.'),
    ('whitespace_blank_only', '     ', ''),
    ('whitespace_leading_newlines', '\n\n   Текст здесь', 'Текст здесь'),
    ('whitespace_leading_trailing', '  Привет мир  ', 'Привет мир'),
    ('whitespace_multiple_internal', 'Привет     мир', 'Привет мир'),
    ('whitespace_nbsp', '\xa0Привет\xa0\xa0мир\xa0', 'Привет\xa0\xa0мир'),
    ('whitespace_newline_collapse', 'Первый абзац.\n\n\n\nВторой абзац.', 'Первый абзац.\n\nВторой абзац.'),
    ('whitespace_number_collapse', 'Всего   5   штук', 'Всего пять штук'),
    ('whitespace_tabs', 'Привет\t\tмир\t', 'Привет мир'),
]
#: The source range of every character, for some of them.
CHAR_MAPS = {
    'size_mb': [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7), (7, 8), (8, 9), (9, 10), (10, 11), (11, 16), (11, 16), (11, 16), (11, 16), (11, 16), (11, 16), (11, 16), (11, 16), (11, 16), (11, 16), (11, 16), (11, 16), (16, 17)],
    'greek_letters': [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7), (7, 8), (8, 9), (8, 9), (8, 9), (8, 9), (8, 9), (8, 9), (8, 9), (9, 10), (10, 11), (11, 12), (12, 13), (12, 13), (12, 13), (12, 13), (12, 13), (12, 13), (13, 14), (14, 15), (15, 16), (16, 17), (16, 17), (16, 17), (16, 17), (16, 17), (16, 17), (16, 17), (17, 18)],
    'markdown_link': [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7), (8, 14), (8, 14), (8, 14), (8, 14), (8, 14), (8, 14), (8, 14), (35, 36)],
    'markdown_list_number': [(0, 3), (0, 3), (0, 3), (0, 3), (0, 3), (0, 3), (0, 3), (3, 4), (4, 5), (5, 6), (6, 7), (7, 8), (8, 9), (9, 10), (10, 13), (10, 13), (10, 13), (10, 13), (10, 13), (10, 13), (10, 13), (13, 14), (14, 15), (15, 16), (16, 17), (17, 18), (18, 19), (19, 20), (20, 23), (20, 23), (20, 23), (20, 23), (20, 23), (20, 23), (20, 23), (23, 24), (24, 25), (25, 26), (26, 27), (27, 28), (28, 29), (29, 30)],
    'tilde_approx': [(0, 2), (0, 2), (0, 2), (0, 2), (0, 2), (0, 2), (0, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7), (7, 8), (8, 9), (9, 10)],
    'whitespace_nbsp': [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7), (7, 8), (8, 9), (9, 10), (10, 11), (11, 12)],
    'range_percent': [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7), (7, 8), (8, 14), (8, 14), (8, 14), (8, 14), (8, 14), (8, 14), (8, 14), (8, 14), (8, 14), (8, 14), (8, 14), (8, 14), (8, 14), (8, 14), (8, 14), (8, 14), (8, 14), (8, 14), (8, 14), (8, 14), (8, 14), (8, 14), (8, 14), (8, 14), (8, 14), (8, 14), (8, 14), (8, 14), (8, 14), (8, 14), (8, 14), (14, 15), (15, 16), (16, 17), (17, 18), (18, 19), (19, 20), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25)],
    'number_embedded_score': [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 7), (5, 7), (5, 7), (5, 7), (5, 7), (5, 7), (7, 8), (8, 9), (8, 9), (8, 9), (8, 9), (9, 10), (10, 11), (11, 12), (12, 13), (13, 14), (14, 15), (15, 16), (16, 17), (17, 18), (18, 19), (19, 20), (20, 21), (21, 22), (22, 23), (23, 24)],
}
# End of fixed values
