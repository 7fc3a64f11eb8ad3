"""Pieces of DuckDB SQL for the readers, spelled out from their rules."""

from __future__ import annotations

from lectern.functions import lexicon as L


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listing(words: list[str]) -> str:
    return "[" + ", ".join(map(quote, words)) + "]"


def mapping(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in table.items()) + "}"


def decline(n: str, forms: tuple[str, str, str]) -> str:
    return f"(CASE WHEN abs({n}) % 100 BETWEEN 11 AND 19 THEN {quote(forms[2])} WHEN abs({n}) % 10 = 1 THEN {quote(forms[0])} WHEN abs({n}) % 10 BETWEEN 2 AND 4 THEN {quote(forms[1])} ELSE {quote(forms[2])} END)"


def triad(n: str, feminine: bool = False) -> str:
    ones = listing(L.ONES_FEMININE if feminine else L.ONES)
    return f"concat_ws(' ', nullif({listing(L.HUNDREDS)}[({n}) // 100 + 1], ''), CASE WHEN ({n}) % 100 >= 20 THEN {listing(L.TENS)}[({n}) % 100 // 10 + 1] END, nullif({ones}[CASE WHEN ({n}) % 100 < 20 THEN ({n}) % 100 ELSE ({n}) % 10 END + 1], ''))"


def words(n: str, feminine: bool = False) -> str:
    """Of numbers from 0 to below 10**12."""
    part = lambda x, forms, fem: f"CASE WHEN {x} > 0 THEN {triad(x, fem)} || ' ' || {decline(x, forms)} END"
    return (
        f"CASE WHEN ({n}) = 0 THEN 'ноль' ELSE concat_ws(' ', {part(f'(({n}) // 1000000000)', L.BILLION, False)}, {part(f'(({n}) // 1000000 % 1000)', L.MILLION, False)}, "
        f"{part(f'(({n}) // 1000 % 1000)', L.THOUSAND, True)}, CASE WHEN ({n}) % 1000 > 0 THEN {triad(f'(({n}) % 1000)', feminine)} END) END"
    )


def year(n: str) -> str:
    head = f"{words(f'(({n}) // 1000)', True)} || ' ' || {decline(f'(({n}) // 1000)', L.THOUSAND)}"
    below = f"(({n}) % 100)"
    ordinal = f"CASE WHEN {below} < 20 THEN {listing(L.ORDINAL_GENITIVE)}[{below} + 1] WHEN {below} % 10 = 0 THEN {listing(L.TENS_ORDINAL)}[{below} // 10 + 1] || 'ого' ELSE {listing(L.TENS)}[{below} // 10 + 1] || ' ' || {listing(L.ORDINAL_GENITIVE)}[{below} % 10 + 1] END"
    return (
        f"CASE WHEN ({n}) = 2000 THEN 'двухтысячного' WHEN ({n}) % 1000 = 0 THEN {words(f'(({n}) // 1000)', True)} || 'тысячного' "
        f"WHEN {below} = 0 THEN {head} || ' ' || {listing(L.HUNDREDS_ORDINAL)}[({n}) // 100 % 10 + 1] || 'ого' "
        f"ELSE concat_ws(' ', CASE WHEN ({n}) >= 1000 THEN {head} END, nullif({listing(L.HUNDREDS)}[({n}) // 100 % 10 + 1], ''), {ordinal}) END"
    )
