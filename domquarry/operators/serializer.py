"""Trees to text: the rules by node, and the flattening of a tree to rows with offsets into its text and markup."""

from __future__ import annotations

VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link menuitem meta param source track wbr".split())
RAW = frozenset("style script xmp iframe noembed noframes plaintext noscript".split())
NEWLINE_EATERS = frozenset(("pre", "textarea", "listing"))


def attribute_value(s: str) -> str:
    return s.replace("&", "&amp;").replace("\u00a0", "&nbsp;").replace('"', "&quot;")


def text_markup(s: str, parent_tag: str | None) -> str:
    if parent_tag in RAW:
        return s
    return s.replace("&", "&amp;").replace("\u00a0", "&nbsp;").replace("<", "&lt;").replace(">", "&gt;")


def start_tag(tag: str, attrs: dict[str, str]) -> str:
    if not attrs:
        return f"<{tag}>"
    parts = "".join(f' {"xmlns" if k == "xmlns:xmlns" else k}="{attribute_value(v)}"' for k, v in attrs.items())
    return f"<{tag}{parts}>"


def leaf_markup(kind: str, data: str | None, tag: str | None, parent_tag: str | None) -> str:
    if kind == "text":
        return text_markup(data, parent_tag)
    return f"<!--{data}-->" if kind == "comment" else f"<!DOCTYPE {tag}>"


FIELDS = (
    "node_id subtree_end parent_id parent_el_id depth node_type tag ns attrs data public_id system_id child_idx el_idx el_count n_children is_empty rev_id "
    "text_start text_end html_start html_end inner_start inner_end"
).split()
_REV, _TEXT_END, _HTML_START, _HTML_END, _INNER_START, _INNER_END = map(FIELDS.index, "rev_id text_end html_start html_end inner_start inner_end".split())


def flatten(root) -> tuple[list[list], str, str]:
    """Rows of FIELDS in tree order (the root is 0), the whole text and the whole markup."""
    rows: list[list] = []
    text: list[str] = []
    html: list[str] = []
    n_text = n_html = 0
    # (node, row or None when entering, parent's row, child_idx, el_idx, el_count, hidden by a void parent)
    todo: list[tuple] = [(root, None, None, 0, None, None, False)]
    while todo:
        node, row, parent, child_idx, el_idx, el_count, hidden = todo.pop()
        if row is not None:  # leaving
            row[1] = len(rows) - 1
            row[_TEXT_END] = n_text
            void = node.kind == "element" and node.tag in VOID
            if not hidden:
                row[_INNER_END] = n_html
                if node.kind == "element" and not void:
                    end = f"</{node.tag}>"
                    html.append(end)
                    n_html += len(end)
                row[_HTML_END] = n_html
            continue
        kind, children = node.kind, node.children
        n_el, empty = 0, True
        for c in children:
            if c.kind == "element":
                n_el += 1
                empty = False
            elif c.kind == "text" and c.data:
                empty = False
        up = parent[0] if parent else None
        up_el = up if parent and parent[5] == "element" else None
        row = [
            len(rows), len(rows), up, up_el, parent[4] + 1 if parent else 0, kind, node.tag if kind == "element" or kind == "doctype" else None, node.ns,
            node.attrs if kind == "element" else None, node.data, node.public_id, node.system_id, child_idx, el_idx, el_count, len(children),
            kind == "element" and empty, None, n_text, n_text, None, None, None, None,
        ]
        rows.append(row)
        if kind == "text":
            text.append(node.data)
            n_text += len(node.data)
            row[_TEXT_END] = n_text
        if not hidden:
            row[_HTML_START] = n_html
            if kind == "element":
                s = start_tag(node.tag, node.attrs)
                if node.tag in NEWLINE_EATERS and children and children[0].kind == "text" and children[0].data.startswith("\n"):
                    s += "\n"
            elif kind == "document":
                s = ""
            else:
                s = leaf_markup(kind, node.data, node.tag, parent[6] if parent and parent[5] == "element" else None)
            html.append(s)
            n_html += len(s)
            row[_INNER_START] = n_html
            if kind not in ("element", "document"):
                row[_HTML_END] = n_html
                row[_INNER_START] = row[_INNER_END] = None
        if kind in ("element", "document"):
            todo.append((node, row, parent, child_idx, el_idx, el_count, hidden))
            below = hidden or (kind == "element" and node.tag in VOID)
            k = n_el
            for i in range(len(children) - 1, -1, -1):
                c = children[i]
                if c.kind != "element":
                    todo.append((c, None, row, i, None, None, below))
                elif kind == "element":
                    todo.append((c, None, row, i, k, n_el, below))
                    k -= 1
                else:  # without a parent element: first, but of none
                    todo.append((c, None, row, i, 1, 0, below))
    for row in rows:
        up = row[2]
        row[_REV] = 0 if up is None else rows[up][_REV] + 1 + rows[up][1] - row[1]
    return rows, "".join(text), "".join(html)


def markup(root) -> str:
    return flatten(root)[2]
