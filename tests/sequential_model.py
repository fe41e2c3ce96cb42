"""A strictly sequential reading of the history rules, row by row, to hold the distributed plan against."""

import re

EVM = re.compile(r"0x[0-9a-f]{40}")
HOUR, MINUTE = 3_600_000, 60_000


def near(a, b):
    return a != b and a[2:6] == b[2:6] and a[-4:] == b[-4:]


def shared(a, b):
    a, b = a[2:], b[2:]
    pre = next((i for i in range(40) if a[i] != b[i]), 40)
    suf = next((i for i in range(40) if a[-1 - i] != b[-1 - i]), 40)
    return pre, suf


def best_match(address, known):
    best = None
    for k, source in known:
        if k == address or not EVM.fullmatch(k) or not near(address, k):
            continue
        pre, suf = shared(address, k)
        if best is None or pre + suf > best[2] + best[3]:
            best = (k, source, pre, suf)
    return best


def run(rows, cfg, ttl_ms):
    """rows: dicts in arrival order. Yields (seq, blocked, set of (check id, verdict), best match)."""
    nonces, velocity, spend, pins, cps, incidents = {}, {}, {}, {}, {}, {}
    for r in rows:
        t, agent, payee, domain, usd = r["ms"], r["agent_key"], r["pay_to_lc"], r["domain"], r["usd"]
        out, block, match = set(), r["local_block"], None

        def add(cid, verdict):
            nonlocal block
            out.add((cid, verdict))
            block = block or verdict == "block"

        key = r["nonce_key"]
        if key is None:
            add("replay.no_nonce", "flag")
        else:
            if key in nonces and t - nonces[key] > ttl_ms:
                del nonces[key]
            if key in nonces:
                add("replay.nonce_reuse", "block")
            else:
                nonces[key] = t
                add("replay.clean", "allow")
        pair = (agent, payee) if agent and payee else None
        cumulative = (spend.get(pair, 0) if pair else 0) + (usd or 0)
        single = usd is not None and usd >= cfg.micro_bypass_usd
        cum = not single and pair is not None and cumulative >= cfg.micro_bypass_usd
        unt = not single and not cum and r["untrusted"] and r["has_content"]
        deep = single or cum or unt
        if deep and r["deep_block"]:
            block = True
        if deep and unt:
            add("tier.deep_untrusted_origin", "allow")
        if deep and cum and r["has_content"]:
            add("tier.deep_cumulative", "allow")
        if not deep and r["has_content"]:
            add("tier.deep_bypassed", "allow")
        established = domain in pins and pins[domain] == payee and payee is not None
        if r["untrusted"]:
            good = r["has_content"] and established and r["content_clean"]
            add("injection.untrusted_origin_mitigated" if good else "injection.untrusted_origin", "allow" if good else "flag")
        known = [(a, "counterparty") for a in cps.get(agent, [])] + [(p, "pin") for p in pins.values()]
        if payee and EVM.fullmatch(payee) and known and all(k != payee for k, _ in known):
            match = best_match(payee, known)
            if match:
                add("poison.lookalike", "block")
        bait, bait_best = None, None
        for c in r["candidates"]:
            b = best_match(c, ([(payee, "payee")] if payee and EVM.fullmatch(payee) else []) + known)
            if b and (bait_best is None or b[2] + b[3] > bait_best[2] + bait_best[3]):
                bait, bait_best = c, b
        if bait:
            add("poison.lookalike_in_content", "block" if r["untrusted"] else "flag")
        existed = domain in pins
        knew = payee in cps.get(agent, [])
        if domain and payee:
            if not existed:
                pins[domain] = payee
                add("pin.created", "allow")
            else:
                add("pin.match" if pins[domain] == payee else "pin.mismatch", "allow" if pins[domain] == payee else "block")
        else:
            add("pin.unscoped", "allow")
        if r["direction"] == "outgoing":
            if not agent:
                add("velocity.unscoped", "flag")
            else:
                ev = [e for e in velocity.get(agent, []) if t - e[0] < HOUR]
                n = sum(1 for e in ev if t - e[0] < MINUTE) + 1
                total = sum(e[1] for e in ev) + (usd or 0)
                velocity[agent] = ev + [(t, usd or 0)]
                vel = 0
                if n >= 2 * cfg.max_payments_per_minute:
                    add("velocity.rate_block", "block")
                    vel += 1
                elif n >= cfg.max_payments_per_minute:
                    add("velocity.rate_flag", "flag")
                    vel += 1
                if total > cfg.max_usd_per_hour:
                    add("velocity.spend_cap", "block")
                    vel += 1
                if payee and not knew:
                    if usd is not None and usd > cfg.first_payment_max_usd:
                        add("velocity.first_contact_size", "flag")
                        vel += 1
                    cps.setdefault(agent, []).append(payee)
                if not vel:
                    add("velocity.clean", "allow")
        seen_by = incidents.get(payee)
        if seen_by:
            w = round(sum(0.5 * 2 ** (-(t - at) / (90 * 24 * HOUR)) for at in seen_by.values()) + 1e-12, 2)
            if w > 0.1:
                add("reputation.injection_history", "flag")
        if block:
            if not knew and agent and payee in cps.get(agent, []) and r["direction"] == "outgoing":
                cps[agent].remove(payee)
            if domain and not existed:
                pins.pop(domain, None)
            implicated = list(r["implicated"]) + ([bait] if bait and r["untrusted"] else [])
            for a in implicated:
                incidents.setdefault(a, {}).setdefault(agent or "anon", t)
        if pair and usd is not None and usd > 0:
            spend[pair] = spend.get(pair, 0) + usd
        yield r["seq"], block, out, match
