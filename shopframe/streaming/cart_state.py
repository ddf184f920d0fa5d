"""S1 on Spark's keyed state: the cart lines of all (user, variant) keys.

The state store holds the lines in pages: a key's page is its hash modulo the
number of pages, and a page is one value, the JSON list of its lines. A call
between Python and the state store costs much the same whatever it carries, so a
page of some hundred lines costs about what a single line would.
The number of pages follows the size of the stored cart when the stream first
starts (``page_count``) and stays with its checkpoint.

The store starts with the stored cart, every micro-batch's commands change it in
``seq`` order (rules of ``operators.cart_fold``), and the store itself is the
current cart: it is read with the state data source, and no log is read again. A
removed line leaves its page at once, an empty page the store, so the store holds
the lines of the cart and nothing else.
"""

from __future__ import annotations

import json
import sys as _sys

from pyspark import cloudpickle as _cloudpickle
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor

from ..operators.cart_fold import _decide

LINE = ["user_id", "variant_id", "quantity", "is_gift", "id"]
PAGE = "lines string"       # [[user_id, ...], ...] in the order of LINE
OUTCOME = "seq long, user_id long, variant_id long, op string, accepted boolean, reason string, quantity_after long"
PAGE_LINES = 256        # lines a page has when the stream starts
MIN_PAGES = 4096        # for carts that are small or empty at first


def page_count(lines: int) -> int:
    return max(MIN_PAGES, -(-lines // PAGE_LINES))


class CartPage(StatefulProcessor):
    def __init__(self, base: int):
        self.base = base

    def init(self, handle):
        self.page = handle.getValueState("page", PAGE)

    def handleInitialState(self, key, row, timers):
        self.page.update((row.lines,))

    def handleInputRows(self, key, rows, timers):
        held = self.page.get()
        lines = {(u, v): line for u, v, *line in json.loads(held[0])} if held else {}
        for r in sorted(rows, key=lambda r: (r.seq is not None, r.seq)):
            at = (r.user_id, r.variant_id)
            quantity, gift, own = lines.get(at, (None, None, None))
            reason = _decide(r.op, r.qty, r.stock, quantity)
            if reason is None:
                if r.op == "remove":
                    quantity = None
                elif quantity is None:
                    quantity, gift, own = r.qty, r.is_gift, self.base + r.seq
                else:
                    quantity += r.qty
            if quantity is not None:
                lines[at] = (quantity, gift, own)
            else:
                lines.pop(at, None)
            yield Row(seq=r.seq, user_id=r.user_id, variant_id=r.variant_id, op=r.op, accepted=reason is None,
                      reason=reason, quantity_after=quantity)
        if lines:
            self.page.update((json.dumps([(*at, *line) for at, line in lines.items()]),))
        elif held:
            self.page.clear()

    def close(self):
        pass


# Shipped by value: workers need not have this package on their path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
