"""From a model's raw output to a card: strict JSON first, then logged repairs, then the schema."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any, NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritome.functions.text import SCHEMA_SENTINELS

# Names of repairs, and keys of a card.
FENCES, OBJECT, COMMA, QUOTES = "cercas_de_codigo", "objeto_extraido_do_texto", "virgula_final", "aspas_tipograficas"
ENVELOPE, NO_ENVELOPE, PAGE, SENTINEL, MISSING = "envelope_ficha", "cot_sem_envelope", "pagina_para_int", "limitacao_sentinela", "limitacao_ausente"
SEMANTIC = {SENTINEL, MISSING}
TEXT_KEYS = {"problema": "problem", "dados": "data", "metodo": "method", "metrica": "metric"}
MIN_QUOTE = 20

CARD = T.StructType(
    [T.StructField(n, T.StringType()) for n in (*TEXT_KEYS.values(), "limitation")]
    + [T.StructField("evidence", T.StructType([T.StructField("quote", T.StringType()), T.StructField("page", T.LongType())]))]
)
PARSED = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("card", CARD),
        T.StructField("first_try", T.BooleanType()),
        T.StructField("repairs", T.ArrayType(T.StringType())),
        T.StructField("error", T.StringType()),
        T.StructField("reasoning", T.StringType()),
    ]
)
_STRING = re.compile(r'"(?:[^"\\]|\\.)*+(?:"|\Z)', re.DOTALL)


def card_schema() -> dict:
    """JSON schema of a card as a prompt shows it: every key required, the limitation nullable."""
    text = {"type": "string", "minLength": 1}
    evidence = {"type": "object", "properties": {"trecho": {"type": "string", "minLength": MIN_QUOTE}, "pagina": {"type": "integer", "minimum": 1}}, "required": ["trecho", "pagina"], "additionalProperties": False}
    properties = {k: text for k in TEXT_KEYS} | {"limitacao": {"type": ["string", "null"]}, "evidencia": evidence}
    return {"type": "object", "properties": properties, "required": list(properties), "additionalProperties": False}


class Parsed(NamedTuple):
    status: str
    card: dict | None
    first_try: bool
    repairs: list[str]
    error: str | None
    reasoning: str | None


def unfenced(text: str) -> str:
    """Inside of the first code fence; an unclosed fence loses its opening."""
    shut = re.search(r"```[ \t]*(?:json|JSON)?[ \t]*\n?(.*?)```", text, re.DOTALL)
    return shut[1].strip() if shut else re.sub(r"\A\s*```[ \t]*(?:json|JSON)?[ \t]*\n?", "", text, count=1)


def first_object(text: str) -> str | None:
    """First balanced braces outside strings: strings are skipped whole, braces counted."""
    start = text.find("{")
    if start < 0:
        return None
    depth = 0
    for m in re.compile(r'"(?:[^"\\]|\\.)*+(?:"|\Z)|[{}]', re.DOTALL).finditer(text, start):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if not depth:
            return text[start : m.end()]
    return None


def without_trailing_commas(text: str) -> str:
    return re.sub(r'("(?:[^"\\]|\\.)*+(?:"|\Z))|,(?=[ \t\r\n]*+[}\]])', lambda m: m[1] or "", text, flags=re.DOTALL)


def straight_quotes(text: str) -> str:
    return text.translate(dict.fromkeys(map(ord, "“”„″"), '"'))


REPAIRS: tuple[tuple[str, Callable[[str], str | None]], ...] = (
    (FENCES, unfenced), (OBJECT, first_object), (COMMA, without_trailing_commas), (QUOTES, straight_quotes), (OBJECT, first_object), (COMMA, without_trailing_commas),
)


def _loaded(text: str) -> tuple[Any, str | None]:
    try:
        return json.loads(text), None
    except json.JSONDecodeError as e:
        return None, f"JSON inválido: {e.msg} (linha {e.lineno}, coluna {e.colno})"
    except RecursionError:
        return None, "JSON inválido: aninhado demais"


def _problems(obj: dict) -> list[str]:
    """What keeps an object from being a card, field by field."""
    out = []
    for key in TEXT_KEYS:
        if key not in obj:
            out.append(f"{key}: ausente")
        elif not isinstance(obj[key], str):
            out.append(f"{key}: não é texto")
        elif not obj[key]:
            out.append(f"{key}: vazio")
    if not isinstance(obj.get("limitacao"), str | None):
        out.append("limitacao: não é texto")
    ev = obj.get("evidencia")
    if not isinstance(ev, dict):
        out.append("evidencia: ausente" if "evidencia" not in obj else "evidencia: não é um objeto")
    else:
        quote, page = ev.get("trecho"), ev.get("pagina")
        if not isinstance(quote, str):
            out.append("evidencia.trecho: ausente ou não é texto")
        elif len(quote) < MIN_QUOTE:
            out.append(f"evidencia.trecho: menos de {MIN_QUOTE} caracteres")
        if not isinstance(page, int) or isinstance(page, bool):
            out.append("evidencia.pagina: ausente ou não é inteiro")
        elif page < 1:
            out.append("evidencia.pagina: menor que 1")
        out += [f"evidencia.{k}: chave a mais" for k in ev if k not in ("trecho", "pagina")]
    return out + [f"{k}: chave a mais" for k in obj if k not in (*TEXT_KEYS, "limitacao", "evidencia")]


_PAGE = re.compile(r"\s*\[?\s*(?:p|pp|pg|pag|pág|page|pagina|página)?\.?\s*(\d+)\s*\]?\s*", re.IGNORECASE)


def _page_number(page: Any) -> int | None:
    if isinstance(page, str):
        m = _PAGE.fullmatch(page)
        return int(m[1]) if m else None
    return int(page) if isinstance(page, float) and page.is_integer() else None


def parse(text: str | None, chain_of_thought: bool = False) -> Parsed:
    """Total: every text gives a status, never an exception."""
    text, repairs = text or "", []
    obj, error = _loaded(text)
    strict = error is None
    current = text
    for name, repair in REPAIRS if error else ():
        new = repair(current)
        if new is None or new == current:
            continue
        current = new
        repairs += [name] * (name not in repairs)
        obj, error = _loaded(current)
        if error is None:
            break
    if error is not None:
        return Parsed("failed", None, False, repairs, error if "{" in text else "Nenhum objeto JSON na saída", None)
    if not isinstance(obj, dict):
        return Parsed("failed", None, False, repairs, f"JSON não é um objeto (veio {type(obj).__name__})", None)
    reasoning = None
    if isinstance(obj.get("ficha"), dict) and obj.keys() <= {"ficha", "raciocinio"}:
        repairs += [] if chain_of_thought else [ENVELOPE]
        reasoning = obj["raciocinio"] if isinstance(obj.get("raciocinio"), str) else None
        obj = obj["ficha"]
    elif chain_of_thought:
        repairs.append(NO_ENVELOPE)
    ev = obj.get("evidencia")
    if isinstance(ev, dict) and (page := _page_number(ev.get("pagina"))) is not None:
        obj = obj | {"evidencia": ev | {"pagina": page}}
        repairs.append(PAGE)
    if problems := _problems(obj):
        more = f"; (+{len(problems) - 5} erros)" if len(problems) > 5 else ""
        return Parsed("failed", None, False, repairs, "Schema inválido: " + "; ".join(problems[:5]) + more, reasoning)
    limitation = obj.get("limitacao")
    if "limitacao" not in obj:
        repairs.append(MISSING)
    elif limitation is not None and limitation.strip().lower() in SCHEMA_SENTINELS:
        limitation = None
        repairs.append(SENTINEL)
    card = {ours: obj[theirs] for theirs, ours in TEXT_KEYS.items()}
    card |= {"limitation": limitation, "evidence": {"quote": obj["evidencia"]["trecho"], "page": obj["evidencia"]["pagina"]}}
    return Parsed("repaired" if repairs else "ok", card, strict and set(repairs) <= SEMANTIC, repairs, None, reasoning)


def parsed(raw: Column, chain_of_thought: bool = False) -> Column:
    """Struct of status, card, first_try, repairs, error, reasoning."""
    kind = F.udf(lambda t: parse(t, chain_of_thought)._asdict(), PARSED, useArrow=True)
    return kind(raw)


