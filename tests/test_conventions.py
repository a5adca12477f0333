"""Convention loader (S5): validation, first domain wins, last event wins."""

from plansight.sources.conventions import load_conventions

DOC_A = """domain: shop
description: Shop events
status: stable
version: "1.0"
events:
  - name: cart_checkout_attempt
    lifecycle: attempt
    description: >
      Checkout
      started.
    attributes:
      required:
        - name: cart_id
          type: string
          description: Cart.
        - name: payment
          type: enum
          values: [card, wallet]
          description: How.
      optional: []
  - name: shared_event_start
    lifecycle: start
    description: first
    attributes: {required: [], optional: []}
"""
DOC_A2 = DOC_A.replace("Shop events", "duplicate domain, ignored").replace("cart_checkout_attempt", "ignored_attempt")
DOC_B = """domain: team
description: Team events
status: experimental
version: "2"
events:
  - name: shared_event_start
    lifecycle: start
    description: second
    attributes: {required: [{name: team_id, type: string}], optional: []}
"""
BAD = """domain: broken
description: bad lifecycle
status: stable
version: "1"
events:
  - name: x_y
    lifecycle: maybe
    description: d
    attributes: {required: [], optional: []}
"""


def test_load_conventions(spark, tmp_path):
    for sub, doc in (("a", DOC_A), ("b", DOC_A2), ("c", DOC_B), ("d", BAD)):
        (tmp_path / sub).mkdir()
        (tmp_path / sub / "events.yaml").write_text(doc)
    (tmp_path / "e.yml").write_text("not: [valid")
    ev, at = load_conventions(spark, str(tmp_path))
    events = {r.name: (r.domain, r.description) for r in ev.collect()}
    assert events == {"cart_checkout_attempt": ("shop", "Checkout started."),
                      "shared_event_start": ("team", "second")}
    attrs = {(r.event_name, r.attr): (r.required, r.values) for r in at.collect()}
    assert attrs == {("cart_checkout_attempt", "cart_id"): (True, None),
                     ("cart_checkout_attempt", "payment"): (True, ["card", "wallet"]),
                     ("shared_event_start", "team_id"): (True, None)}
