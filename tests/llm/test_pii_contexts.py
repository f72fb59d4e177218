"""Unseen identifiers in planted contexts, for each kind."""

from tests.llm.test_pii import luhn, report


def card(i):
    head = f"411111111111{i:03d}"
    return next(head + c for c in "0123456789" if luhn(head + c))


def four(digits, sign):
    return sign.join(digits[k : k + 4] for k in range(0, 16, 4))


SEEDS = {
    "email": lambda i: f"user{i}@mail{i}.example.com",
    "ip": lambda i: f"10.0.{i}.7",
    "card": lambda i: four(card(i), "- "[i % 2]),
    "phone": lambda i: f"+49 171 55 10{i:02d}",
}
UNSEEN = {
    "email": ["user.99@localhost", "anna@localhost", "a" * 70 + "1@localhost", "anna (at) web-site dot example dot org", "b.lee[at]example.org", "joe at example.org"],
    "ip": ["fe80:0:0:1:2:3"],
    "card": ["4111-1111-1111-1112", "4111 1111 1111 1112", "4111111111111112"],
    "phone": ["0171-5551234", "(0171) 555 1234", "0171 555 12 34"],
}


WORDS = {"email": "write to", "ip": "served from", "card": "charge it", "phone": "call at"}
AFTER = {"email": "about news", "ip": "since monday", "card": "every month", "phone": "before noon"}


def test_unseen_values_of_each_kind_and_new_patterns(spark):
    rows, want = [(900, f"well then {WORDS['card']} number77 {AFTER['card']}")], {900: ""}
    for n, kind in enumerate(SEEDS):
        rows += [(1000 * n + 1000 + i, f"well then {WORDS[kind]} {SEEDS[kind](i)} {AFTER[kind]}") for i in range(60)]
        at = len(f"well then {WORDS[kind]} ")
        for i, v in enumerate(UNSEEN[kind]):
            rows.append((10 * n + i, f"well then {WORDS[kind]} {v} {AFTER[kind]}"))
            want[10 * n + i] = f"{kind}:{at}:{at + len(v)}"
    for i in range(20):  # learned in one context, these lead to another that no seed has
        rows += [(500 + i, f"well then {WORDS['ip']} fe80:0:0:1:2:{i:02d} {AFTER['ip']}"), (600 + i, f"machine named inside fe80:0:0:1:2:{i:02d} answers quickly")]
    rows.append((700, "machine named inside fe80:0:0:9:9:99 answers quickly"))
    for i in range(300):
        rows.append((9000 + i, f"well then {WORDS['ip']} 10.1.{i % 250}.{i // 250} {AFTER['ip']}"))
    got = {r.doc_id: r.spans for r in report(spark, rows)}
    assert {i: got[i] for i in want} == want
    assert got[700] == "ip:21:36"


def test_half_of_a_context_unseen_and_long_contexts(spark):
    """As many spelled-out addresses as seeds in one context; words and gaps far longer than any window."""
    far, word = " -" * 300 + " ", "w" * 300
    rows = [(i, f"{word} mail{far}{SEEDS['email'](i)}{far}please {word}") for i in range(40)]
    rows += [(100 + i, f"{word} mail{far}name{i} at host{i} dot org{far}please {word}") for i in range(40)]
    rows += [(200 + i, f"we look at example{i}.org and at the rest") for i in range(40)]
    got = {r.doc_id: r for r in report(spark, rows)}
    at = len(f"{word} mail{far}")
    assert all(got[100 + i].spans == f"email:{at}:{at + len(f'name{i} at host{i} dot org')}" for i in range(40))
    assert all(got[200 + i].spans == "" for i in range(40))


def test_rounds_go_on_until_nothing_is_added(spark):
    """Six contexts, of which each shares values with the next alone."""
    names = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot"]
    rows = [(i, f"so {names[0]} number {SEEDS['phone'](i)} {names[0]} later") for i in range(60)]
    rows += [(1000 + 100 * k + i, f"so {names[k + d]} number 0171 555 {k}{i:02d} 1 {names[k + d]} later") for k in range(5) for i in range(30) for d in (0, 1)]
    got = report(spark, rows)
    assert all(r.spans.count("phone") == 1 for r in got)


def test_a_frequent_word_leads_nowhere(spark):
    rows = [(i, f"about the {SEEDS['phone'](i)} the more") for i in range(30)] + [(100 + i, f"about the {10**9 + i}a the more") for i in range(30)]
    rows += [(200 + i, f"about the 0{171 + i} 555 12{i:02d} the more") for i in range(30)]
    assert all(r.n_learned == 0 for r in report(spark, rows))
