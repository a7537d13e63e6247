"""The same derived relations for the checking engine, as named parts of a WITH clause."""

from __future__ import annotations

from vouchsafe.plans.views import FLAT_OF, FX_DOCS, FX_LINES, confidence_sql
from vouchsafe.schemas import LINE_TYPES, SCALAR_TYPES


def _fx_fields() -> str:
    parts = []
    for i, path in enumerate(SCALAR_TYPES):
        col = FLAT_OF[path]
        parts.append(
            f"select doc_id, {i} as ord, '/{path.replace('.', '/')}' as path, cast({col} as varchar) as value, "
            f"{confidence_sql(str(i), col)} as confidence from fx_docs"
        )
    for k, name in enumerate(LINE_TYPES):
        order = f"12 + 7 * idx + {k}"
        parts.append(
            f"select doc_id, {order} as ord, concat('/line_items/', cast(idx as varchar), '/{name}') as path, "
            f"cast({name} as varchar) as value, {confidence_sql(order, name)} as confidence from fx_items"
        )
    return "\nunion all ".join(parts)


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "fx_lines": ((), FX_LINES.format(HE="round_even", lineitem="lineitem", part="part")),
    "fx_docs": (("fx_lines",), FX_DOCS.format(NEST="", KEEP="", orders="orders", fx_lines="fx_lines")),
    # only lines whose order exists belong to a document
    "fx_items": (
        ("fx_lines", "fx_docs"),
        "select l.*, cast(row_number() over (partition by l.doc_id order by l.ln) - 1 as int) as idx "
        "from fx_lines l semi join fx_docs d on l.doc_id = d.doc_id",
    ),
    "fx_fields": (("fx_docs", "fx_items"), _fx_fields()),
}


def view(name: str, needs: tuple[str, ...], text: str) -> None:
    VIEWS[name] = (needs, text)


def with_views(names: tuple[str, ...], body: str) -> str:
    """``body`` preceded by the views it names and everything they need."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for need in VIEWS[name][0]:
                visit(need)
            ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return body
    parts = ",\n".join(f"{n} as ({VIEWS[n][1]})" for n in ordered)
    text = body.strip()
    if text.lower().startswith("with "):
        return f"with {parts},\n{text[5:]}"
    return f"with {parts}\n{text}"
