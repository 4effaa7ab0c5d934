"""DuckDB SQL for every registered query (the correctness oracle).

Written independently of the Spark code: keywords by GROUP BY + row_number,
transcripts by ordered ``string_agg``, running totals by window sums, the
few-shot rule by a correlated subquery, packing by position arithmetic over
unnested tokens.  Literal wording comes from the same configuration objects.
"""

from __future__ import annotations

import math

from dialogprep.functions.ids import CHECKSUM_BASE, CHECKSUM_MOD
from dialogprep.functions import permutation as PM
from dialogprep.plans import registry as R
from dialogprep.schema import ChatTemplate, PromptText

TX = PromptText()
TM = ChatTemplate()
NL = "chr(10)"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def cat(*parts: str) -> str:
    return "(" + " || ".join(parts) + ")"


def kw_text(kws: str) -> str:
    return f"array_to_string({kws}, {lit(TX.keyword_separator)})"


def fill(template: str, kws: str) -> str:
    pieces = template.split("{keywords}")
    out = [lit(pieces[0])]
    for p in pieces[1:]:
        out += [kw_text(kws), lit(p)]
    return cat(*out)


def transcript(lines: str) -> str:
    return f"({lit(TX.conversation_header)} || coalesce({NL} || {lines}, ''))"


def summary(lines: str, kws: str) -> str:
    return cat(transcript(lines), lit("\n\n" + TX.question_header + "\n"), fill(TX.summary_question, kws))


def topic(lines: str) -> str:
    return cat(transcript(lines), lit("\n\n" + TX.question_header + "\n" + TX.topic_question))


def instruction(labelled: str, kws: str) -> str:
    h1, h2, h3, h4 = TX.instruction_headers
    return cat(lit(f"{h1}\n{TX.instruction}\n\n{h2}\n"), f"coalesce({labelled}, '')", lit(f"\n\n{h3}\n"),
               fill(TX.instruction_user, kws), lit(f"\n\n{h4}\n"))


def render(msgs: list[tuple[str, str]], gen: bool) -> str:
    pre, _, post = TM.turn_start.partition("{role}")
    parts = []
    for role, content in msgs:
        parts += [lit(pre + role + post), content, lit(TM.turn_end)]
    if gen:
        parts.append(lit(TM.generation_prompt))
    return cat(*parts)


def chat_source(lines: str, kws: str, system: str | None = None) -> str:
    return render([("system", system or lit(TX.system)), ("user", summary(lines, kws))], True)


def enc(x: str) -> str:
    """Code-point ids of a string (INT list)."""
    return (f"(CASE WHEN coalesce({x}, '') = '' THEN []::INT[] ELSE "
            f"list_transform(string_split({x}, ''), lambda c: (unicode(c) + 16)::INT) END)")


def byte_enc(x: str) -> str:
    """Byte-level ids (UTF-8 byte + 3) of a string (INT list)."""
    return (f"list_transform(range(0, octet_length(encode({x}))), "
            f"lambda i: (('0x' || substr(hex(encode({x})), 2 * i + 1, 2))::INTEGER + 3))")


def checksum(lst: str) -> str:
    return (f"list_reduce(list_prepend(0::BIGINT, ({lst})::BIGINT[]), "
            f"lambda z, x: (z * {CHECKSUM_BASE} + x) % {CHECKSUM_MOD})")


def repeat(v: int, n: str) -> str:
    return f"list_transform(range({n}), lambda i: {v})"


def md5(x: str) -> str:
    return f"md5({x})"


# -- shared CTEs -------------------------------------------------------------------
EXAMPLES = f"""
t AS (SELECT conv_id, turn, role, text FROM conversations),
lst AS (SELECT conv_id, max(CASE WHEN role = 'assistant' THEN turn END) AS last FROM t GROUP BY conv_id),
kept AS (SELECT t.conv_id, t.turn, t.role, t.text FROM t JOIN lst USING (conv_id)
         WHERE t.role <> 'system' AND (lst.last IS NULL OR t.turn < lst.last)),
wc AS (SELECT conv_id, w, count(*) AS c
       FROM (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS w FROM kept)
       GROUP BY conv_id, w),
kw AS (SELECT conv_id, list(w ORDER BY c DESC, w ASC) AS kws
       FROM (SELECT conv_id, w, c, row_number() OVER (PARTITION BY conv_id ORDER BY c DESC, w ASC) AS rn FROM wc)
       WHERE rn <= 2 GROUP BY conv_id),
tr AS (SELECT conv_id,
              string_agg(role || {lit(TX.turn_separator)} || text, {NL} ORDER BY turn) AS lines,
              string_agg({lit(TX.speaker_label)} || role || {lit(TX.turn_separator)} || text || {NL}, '' ORDER BY turn) AS labelled,
              count(*) AS n_turns,
              string_agg(role, ',' ORDER BY turn) AS roles
       FROM kept GROUP BY conv_id),
ex AS (SELECT l.conv_id, coalesce(o.text, '') AS output, coalesce(kw.kws, []::VARCHAR[]) AS kws,
              tr.lines, tr.labelled, coalesce(tr.n_turns, 0) AS n_turns, coalesce(tr.roles, '') AS roles
       FROM lst l LEFT JOIN (SELECT conv_id AS oc, turn AS ot, text FROM t) o ON o.oc = l.conv_id AND o.ot = l.last
       LEFT JOIN kw ON kw.conv_id = l.conv_id LEFT JOIN tr ON tr.conv_id = l.conv_id)
"""

POOL = f"""
pool AS (SELECT (row_number() OVER (ORDER BY item_id) - 1) AS pos, text FROM benchmark),
budget AS (SELECT pos, text, length(text) + 1 AS n_tokens,
                  sum(length(text) + 1) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
           FROM pool)
"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip() for c in ctes) + "\n"


# The rendered SFT source per example and its ids (chat mode).
SFT = f"""
sft AS (SELECT conv_id, output, {chat_source('lines', 'kws')} AS src FROM ex),
sft_ids AS (SELECT conv_id, list_prepend(1, {enc('src')}) AS s,
                   CASE WHEN output = '' THEN []::INT[] ELSE list_append({enc('output')}, 2) END AS g
            FROM sft)
"""


def few_shot_source() -> str:
    base = f"(length({chat_source('lines', 'kws')}) + 1)"
    pieces = f"""(SELECT coalesce(string_agg({lit(TX.example_header.split('{i}')[0])} || (pos + 1)::VARCHAR ||
                 {lit(TX.example_header.split('{i}')[1])} || text || {lit(TX.example_separator)}, '' ORDER BY pos), '')
                 FROM budget b WHERE b.cum + ex.base <= {R.FEW_SHOT_BLOCK})"""
    return f"""
fs0 AS (SELECT ex.*, {base} AS base FROM ex),
fs AS (SELECT fs0.*, (SELECT count(*) FROM budget b WHERE b.cum + fs0.base <= {R.FEW_SHOT_BLOCK}) AS n_examples,
              {pieces.replace('ex.base', 'fs0.base')} AS prefix FROM fs0)
"""


def one_shot_system(example: str) -> str:
    return cat(example, lit(TX.example_separator + TX.system))


def mode_sources() -> dict[str, str]:
    return {
        "chat": chat_source("lines", "kws"),
        "one_shot": chat_source("lines", "kws", one_shot_system(lit(TX.one_shot_example))),
        "few_shot": chat_source("lines", "kws", cat("prefix", lit(TX.system))),
        "tapt": render([("system", fill(TX.domain_system, "kws")), ("user", transcript("lines"))], False),
        "instruction": instruction("labelled", "kws"),
    }


def _split_hash(key: str) -> str:
    threshold = format(min(int(math.floor(R.TEST_FRACTION * 2 ** 32)), 2 ** 32 - 1), "08x")
    return (f"CASE WHEN substr(md5('split|{R.SEED}|' || {key}::VARCHAR), 1, 8) < '{threshold}' "
            f"THEN 'test' ELSE 'train' END")


PREFS = """
prefs AS (SELECT conv_id,
                 arg_min(text, turn) FILTER (WHERE role = 'user') AS prompt,
                 arg_max(text, turn) FILTER (WHERE role = 'assistant') AS chosen,
                 arg_min(text, turn) FILTER (WHERE role = 'assistant') AS rejected,
                 count(*) FILTER (WHERE role = 'assistant') AS n_asst
          FROM conversations GROUP BY conv_id HAVING count(*) FILTER (WHERE role = 'assistant') >= 2)
"""


def _split_exact(table: str) -> str:
    return f"""
ranked AS (SELECT *, row_number() OVER (ORDER BY md5('split|{R.SEED}|' || conv_id::VARCHAR), conv_id) - 1 AS rk,
                  count(*) OVER () AS n FROM {table}),
splitx AS (SELECT *, CASE WHEN rk < ceil(n * {float(R.TEST_FRACTION)}::DOUBLE) THEN 'test' ELSE 'train' END AS split
           FROM ranked)
"""


def _truncate() -> str:
    ml, mp = R.TRUNC_MAX_LENGTH, R.TRUNC_MAX_PROMPT
    return f"""
tok AS (SELECT conv_id, list_prepend(1, {enc('prompt')}) AS p, list_append({enc('chosen')}, 2) AS c,
               list_append({enc('rejected')}, 2) AS r FROM prefs),
t1 AS (SELECT conv_id, c, r, greatest(len(c), len(r)) AS lg,
              CASE WHEN len(p) + greatest(len(c), len(r)) > {ml} AND len(p) > {mp}
                   THEN p[len(p) - {mp} + 1:] ELSE p END AS p FROM tok),
t2 AS (SELECT conv_id, p,
              CASE WHEN len(p) + lg > {ml} THEN c[1:{ml - mp}] ELSE c END AS c,
              CASE WHEN len(p) + lg > {ml} THEN r[1:{ml - mp}] ELSE r END AS r FROM t1)
"""


def _train_dev() -> str:
    return f"""
e AS (SELECT conv_id, len(s) + len(g) AS n_tokens, {_split_hash('conv_id')} AS hs FROM sft_ids),
td AS (SELECT conv_id, 'train' AS split, n_tokens FROM e
       UNION ALL SELECT conv_id, 'eval' AS split, n_tokens FROM e WHERE hs = 'test')
"""


def _generated_predict(src: str) -> str:
    marker = TX.conversation_header + "\n"
    after = f"string_split({src}, {lit(marker)})[-1]"
    return f"left(split_part({after}, {NL}, 1), {R.MAX_NEW_TOKENS})"


def _pack() -> str:
    B, G = R.PACK_BLOCK, R.PACK_GROUP_ROWS
    return f"""
rows AS (SELECT conv_id, (row_number() OVER (ORDER BY conv_id) - 1) // {G} AS grp, list_concat(s, g) AS ids,
                list_concat({repeat(-100, 'len(s)')}, g) AS lab FROM sft_ids),
off AS (SELECT *, coalesce(sum(len(ids)) OVER (PARTITION BY grp ORDER BY conv_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
               sum(len(ids)) OVER (PARTITION BY grp) AS total FROM rows),
tokens AS (SELECT grp, start + i - 1 AS gpos, ids[i] AS id, lab[i] AS lb, total
           FROM off, range(1, len(ids) + 1) AS r(i)),
kept_tokens AS (SELECT grp, gpos // {B} AS chunk, gpos, id, lb FROM tokens
                WHERE gpos < CASE WHEN total >= {B} THEN (total // {B}) * {B} ELSE total END)
"""


def _epochs(head: str) -> str:
    """The epochs' orders: the rounds over all of 0 .. a*b-1, then the walk back below n."""
    head = head.strip().removeprefix("WITH").strip()
    parts = [f"""WITH RECURSIVE {head},
        rows_ AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS pos FROM ex),
        n_ AS (SELECT count(*)::BIGINT AS n, CASE WHEN count(*) > 1 THEN floor(sqrt(count(*) - 1))::BIGINT + 1 ELSE 1 END AS root FROM rows_),
        ab AS (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT n, unnest(range(root, root + least(root, {PM.CANDIDATES}))) AS a FROM n_)
               ORDER BY a * ((n + a - 1) // a) - n, a LIMIT 1)"""]
    for e in R.EPOCHS:
        keys = PM.Permutation(1, R.SEED, e).keys
        parts.append(f"f{e}_0 AS (SELECT x, x // b AS l, x % b AS r, n, a, b FROM (SELECT *, unnest(range(a * b)) AS x FROM ab))")
        for i, k in enumerate(keys):
            d, other, width = ("l", "r", "a") if i % 2 == 0 else ("r", "l", "b")
            v = f"(({other} + {k}) % {PM.PRIME})"
            new = f"({d} + ({v} * {v} % {PM.PRIME} * {PM.FACTOR} + {v}) % {PM.PRIME}) % {width}"
            parts.append(f"f{e}_{i + 1} AS (SELECT x, {new if d == 'l' else 'l'} AS l, {new if d == 'r' else 'r'} AS r, n, a, b FROM f{e}_{i})")
        parts.append(f"f{e} AS (SELECT x, l * b + r AS y, n FROM f{e}_{len(keys)})")
        parts.append(f"w{e} AS (SELECT x, y, n FROM f{e} WHERE x < n UNION ALL SELECT w{e}.x, f{e}.y, f{e}.n FROM w{e} JOIN f{e} ON f{e}.x = w{e}.y WHERE w{e}.y >= w{e}.n)")
    return ",\n".join(parts) + "\n" + " UNION ALL ".join(
        f"SELECT conv_id, {e}::BIGINT AS epoch, y::BIGINT AS rank, pos::BIGINT AS back FROM rows_ JOIN w{e} ON x = pos WHERE y < n" for e in R.EPOCHS)


def build() -> dict[str, str]:
    ex = with_(EXAMPLES)
    q: dict[str, str] = {}
    q["assemble_conversations"] = ex + "SELECT conv_id, n_turns::BIGINT AS n_turns, roles, length(output)::BIGINT AS output_chars FROM ex"
    q["format_turns"] = with_(EXAMPLES) + f"""SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS turn,
        role || {lit(TX.turn_separator)} || text AS line FROM kept"""
    q["transcript"] = ex + f"SELECT conv_id, {transcript('lines')} AS transcript FROM ex"
    q["transcript_labelled"] = ex + "SELECT conv_id, coalesce(labelled, '') AS transcript FROM ex"
    q["keywords_text"] = ex + f"SELECT conv_id, {kw_text('kws')} AS keywords FROM ex"
    q["summary_prompt"] = ex + f"SELECT conv_id, {summary('lines', 'kws')} AS prompt FROM ex"
    q["topic_prompt"] = ex + f"SELECT conv_id, {topic('lines')} AS prompt FROM ex"
    q["domain_system_prompt"] = ex + f"SELECT conv_id, {fill(TX.domain_system, 'kws')} AS prompt FROM ex"
    q["instruction_prompt"] = ex + f"SELECT conv_id, {instruction('labelled', 'kws')} AS prompt FROM ex"
    q["chat_messages"] = ex + f"""SELECT conv_id, 0::BIGINT AS pos, 'system' AS role, {lit(TX.system)} AS content FROM ex
        UNION ALL SELECT conv_id, 1::BIGINT AS pos, 'user' AS role, {summary('lines', 'kws')} AS content FROM ex"""
    msgs = [("system", lit(TX.system)), ("user", summary("lines", "kws"))]
    q["render_chat"] = ex + f"""SELECT conv_id, 1::BIGINT AS with_generation_prompt, {render(msgs, True)} AS rendered FROM ex
        UNION ALL SELECT conv_id, 0::BIGINT AS with_generation_prompt, {render(msgs, False)} AS rendered FROM ex"""
    ms = mode_sources()
    q["prompt_modes"] = with_(EXAMPLES, POOL, few_shot_source()) + "\nUNION ALL\n".join(
        f"SELECT conv_id, '{m}' AS mode, md5({src}) AS prompt_md5, length({src})::BIGINT AS n_chars FROM fs"
        for m, src in ms.items())
    shots = []
    for idx in R.ONE_SHOT_INDEXES:
        if idx == 0:
            exm = lit(TX.one_shot_example)
        else:
            target = str(idx) if idx > 0 else f"((SELECT count(*) FROM pool) + ({idx}))"
            exm = f"(SELECT text FROM pool WHERE pos = {target})"
        sysx = one_shot_system(exm)
        shots.append(f"SELECT conv_id, {idx}::BIGINT AS oneshot_idx, md5({sysx}) AS system_md5, "
                     f"length({sysx})::BIGINT AS n_chars FROM ex")
    q["one_shot_prompt"] = with_(EXAMPLES, POOL) + "\nUNION ALL\n".join(shots)
    q["few_shot_budget"] = with_(POOL) + "SELECT pos::BIGINT AS pos, n_tokens::BIGINT AS n_tokens, cum::BIGINT AS cum_tokens FROM budget"
    q["dynamic_few_shot"] = with_(EXAMPLES, POOL, few_shot_source()) + f"""SELECT conv_id, base::BIGINT AS base_tokens,
        n_examples::BIGINT AS n_examples, md5({ms['few_shot']}) AS prompt_md5, length({ms['few_shot']})::BIGINT AS prompt_chars FROM fs"""
    q["tokenize"] = f"""SELECT doc_id, (length(text) + 1)::BIGINT AS n_tokens,
        {checksum(f"list_prepend(1, {enc('text')})")} AS checksum FROM documents"""
    q["detokenize"] = "SELECT doc_id, md5(text) AS text_md5 FROM documents"
    byte_ids = byte_enc("text")
    q["tokenize_pieces"] = f"""SELECT doc_id, (octet_length(encode(text)) + 1)::BIGINT AS n_tokens,
        {checksum(f"list_prepend(1, {byte_ids})")} AS checksum, md5(text) AS text_md5 FROM documents"""
    sft = with_(EXAMPLES, SFT)
    q["sft_examples"] = sft + f"""SELECT conv_id, len(s)::BIGINT AS n_source, len(g)::BIGINT AS n_target,
        len(s)::BIGINT AS n_masked, (len(s) + len(g))::BIGINT AS n_attended,
        {checksum('list_concat(s, g)')} AS ids_checksum,
        {checksum(f"list_concat({repeat(-100, 'len(s)')}, g)")} AS labels_checksum FROM sft_ids"""
    q["sft_examples_pieces"] = with_(EXAMPLES) + f""", bsrc AS (SELECT conv_id, output, {chat_source('lines', 'kws')} AS src FROM ex),
        b AS (SELECT conv_id, list_prepend(1, {byte_enc('src')}) AS s,
                     CASE WHEN output = '' THEN []::INT[] ELSE list_append({byte_enc('output')}, 2) END AS g FROM bsrc)
        SELECT conv_id, len(s)::BIGINT AS n_source, len(g)::BIGINT AS n_target,
            {checksum('list_concat(s, g)')} AS ids_checksum,
            {checksum(f"list_concat({repeat(-100, 'len(s)')}, g)")} AS labels_checksum FROM b"""
    tapt_src = ms["tapt"]
    q["tapt_examples"] = ex + f"""SELECT conv_id, (length({tapt_src}) + 1)::BIGINT AS n_tokens,
        {checksum(f"list_prepend(1, {enc(tapt_src)})")} AS labels_checksum FROM ex"""
    q["training_table"] = sft + f"""SELECT conv_id, (len(s) + len(g))::BIGINT AS n_tokens,
        {checksum('list_concat(s, g)')} AS ids_checksum,
        {checksum(f"list_concat({repeat(-100, 'len(s)')}, g)")} AS labels_checksum,
        (len(s) + len(g))::BIGINT AS mask_sum FROM sft_ids"""
    names = ", ".join(lit(n) for n in R.TOK.special_names)
    def dec(ids: str) -> str:
        return (f"array_to_string(list_transform({ids}, lambda i: CASE WHEN i < 16 THEN [{names}][i + 1] "
                f"ELSE chr(i - 16) END), '')")
    pad = R.TOK.pad_token_id
    q["preview"] = sft + f"""SELECT conv_id, {dec('list_concat(s, g)')} AS input_text,
        {dec(f"list_concat({repeat(pad, 'len(s)')}, g)")} AS label_text FROM sft_ids ORDER BY conv_id LIMIT 1"""
    topic_src = render([("system", lit(TX.system)), ("user", topic("lines"))], True)
    q["multitask_union"] = ex + f"""SELECT conv_id, 'summary' AS task, output AS target,
        (length({chat_source('lines', 'kws')}) + 1)::BIGINT AS n_source FROM ex
        UNION ALL SELECT conv_id, 'topic' AS task, {kw_text('kws')} AS target, (length({topic_src}) + 1)::BIGINT AS n_source FROM ex"""
    q["train_plus_dev"] = with_(EXAMPLES, SFT, _train_dev()) + "SELECT conv_id, split, n_tokens::BIGINT AS n_tokens FROM td"
    q["dataset_stats"] = with_(EXAMPLES, SFT, _train_dev()) + f"""SELECT split, count(*)::BIGINT AS n_rows,
        sum(n_tokens)::BIGINT AS n_tokens, max(n_tokens)::BIGINT AS max_tokens,
        sum(CASE WHEN n_tokens > {R.ROW_TOKEN_LIMIT} THEN 1 ELSE 0 END)::BIGINT AS n_over_limit FROM td GROUP BY split"""
    q["collate_pad"] = with_(EXAMPLES, SFT) + f""", b0 AS (SELECT conv_id,
            (row_number() OVER (ORDER BY md5('shuffle|{R.SEED}|' || conv_id::VARCHAR), conv_id) - 1) // {R.BATCH_SIZE} AS batch_id,
            list_concat(s, g) AS ids, list_concat({repeat(-100, 'len(s)')}, g) AS lab FROM sft_ids),
        b AS (SELECT *, batch_id % {R.N_SHARDS} AS shard FROM b0),
        p AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS pad_to FROM b),
        q AS (SELECT *, list_concat(ids, {repeat(pad, 'pad_to - len(ids)')}) AS pids,
                 list_concat(lab, {repeat(-100, 'pad_to - len(lab)')}) AS plab FROM p)
        SELECT shard::BIGINT AS shard, batch_id::BIGINT AS batch_id, conv_id, pad_to::BIGINT AS pad_to,
            (pad_to - len(ids))::BIGINT AS n_pad, len(list_filter(pids, lambda x: x <> {pad}))::BIGINT AS n_attended,
            {checksum('pids')} AS ids_checksum, {checksum('plab')} AS labels_checksum FROM q"""
    q["collate_eval"] = with_(EXAMPLES, SFT) + f""", b AS (SELECT conv_id,
            (row_number() OVER (ORDER BY conv_id) - 1) // {R.EVAL_BATCH_SIZE} AS batch_id,
            list_concat(s, g) AS ids, list_concat({repeat(-100, 'len(s)')}, g) AS lab FROM sft_ids),
        p AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS pad_to FROM b)
        SELECT batch_id::BIGINT AS batch_id, conv_id, pad_to::BIGINT AS pad_to, len(ids)::BIGINT AS n_attended,
            {checksum(f"list_concat(ids, {repeat(pad, 'pad_to - len(ids)')})")} AS ids_checksum,
            {checksum(f"list_concat(lab, {repeat(-100, 'pad_to - len(lab)')})")} AS labels_checksum FROM p"""
    tapt_ids = f"list_prepend(1, {enc(tapt_src)})"
    topic_ids = f"list_prepend(1, {enc(topic_src)})"
    kw_ids = f"CASE WHEN {kw_text('kws')} = '' THEN []::INT[] ELSE list_append({enc(kw_text('kws'))}, 2) END"
    q["tapt_multitask"] = ex + f"""SELECT conv_id, 'summary' AS task, (length({tapt_src}) + 1)::BIGINT AS n_tokens,
            0::BIGINT AS n_masked, {checksum(tapt_ids)} AS labels_checksum FROM ex
        UNION ALL SELECT conv_id, 'topic' AS task, (len({topic_ids}) + len({kw_ids}))::BIGINT AS n_tokens,
            len({topic_ids})::BIGINT AS n_masked,
            {checksum(f"list_concat({repeat(-100, f'len({topic_ids})')}, {kw_ids})")} AS labels_checksum FROM ex"""
    q["pack_tokens"] = with_(EXAMPLES, SFT, _pack()) + f"""SELECT grp::BIGINT AS "group", chunk::BIGINT AS chunk,
        count(*)::BIGINT AS n_tokens, {checksum('list(id ORDER BY gpos)')} AS ids_checksum,
        {checksum('list(lb ORDER BY gpos)')} AS labels_checksum FROM kept_tokens GROUP BY grp, chunk"""
    q["preference_filter"] = with_(PREFS, _split_exact("prefs")) + f"""SELECT conv_id, split,
        length(prompt)::BIGINT AS prompt_chars, length(chosen)::BIGINT AS chosen_chars, length(rejected)::BIGINT AS rejected_chars
        FROM splitx WHERE length(prompt) + length(chosen) <= {R.PREFERENCE_CUTOFF}
          AND length(prompt) + length(rejected) <= {R.PREFERENCE_CUTOFF}"""
    q["preference_truncate"] = with_(PREFS, _truncate()) + f"""SELECT conv_id, len(p)::BIGINT AS n_prompt,
        len(c)::BIGINT AS n_chosen, len(r)::BIGINT AS n_rejected, {checksum('p')} AS prompt_checksum,
        {checksum('c')} AS chosen_checksum, {checksum('r')} AS rejected_checksum FROM t2"""
    q["split_exact"] = with_(EXAMPLES, _split_exact("ex")) + "SELECT conv_id, split FROM splitx"
    q["split_hash"] = ex + f"SELECT conv_id, {_split_hash('conv_id')} AS split FROM ex"
    q["shuffle_order"] = ex + f"""SELECT conv_id,
        (row_number() OVER (ORDER BY md5('shuffle|{R.SEED}|' || conv_id::VARCHAR), conv_id) - 1)::BIGINT AS rank FROM ex"""
    q["continuation"] = sft + "SELECT conv_id, len(g)::BIGINT AS n_out, output AS text FROM sft_ids JOIN ex USING (conv_id)"
    inf_src = ms["one_shot"]
    q["generate_join"] = ex + f"SELECT conv_id, output, {_generated_predict(inf_src)} AS predict FROM ex"
    q["batched_map"] = ex + """SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS turn,
        length(text)::BIGINT AS n FROM kept QUALIFY length(text) > 0"""
    q["read_examples_json"] = ex + f"""SELECT conv_id, n_turns::BIGINT AS n_turns, md5({transcript('lines')}) AS transcript_md5,
        {kw_text('kws')} AS keywords, md5(output) AS output_md5, 'conversations' AS source FROM ex"""
    q["read_few_shot_csv"] = with_(POOL) + "SELECT pos::BIGINT AS pos, md5(text) AS text_md5 FROM pool"
    q["read_preferences_json"] = with_(PREFS) + "SELECT md5(prompt) AS prompt_md5, md5(chosen) AS chosen_md5, md5(rejected) AS rejected_md5 FROM prefs"
    q["collate_eval_string_key"], q["pack_string_key"] = q["collate_eval"], q["pack_tokens"]
    q["read_examples_rejects"] = f"SELECT DISTINCT conv_id, conv_id % {R.BAD_EVERY} = 0 AS rejected FROM conversations"
    q["read_preferences_rejects"] = with_(PREFS) + f"""SELECT obj, 'missing array' AS why FROM
        (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS obj FROM prefs) WHERE conv_id % {R.BAD_EVERY} = 0"""
    q["preference_preview"] = with_(PREFS, _split_exact("prefs")) + f"""SELECT conv_id, prompt, chosen, rejected FROM splitx
        WHERE split = 'train' AND length(prompt) + length(chosen) <= {R.PREFERENCE_CUTOFF}
          AND length(prompt) + length(rejected) <= {R.PREFERENCE_CUTOFF} ORDER BY conv_id LIMIT 3"""
    q["cached_result"] = ex + "SELECT conv_id, md5(output) AS output_md5, true AS reused FROM ex"
    q["predictions_jsonl"] = ex + f"SELECT conv_id, md5(output) AS output_md5, {_generated_predict(inf_src)} AS predict FROM ex"
    q["submission_records"] = ex + f"""SELECT conv_id, (row_number() OVER (ORDER BY conv_id) - 1)::BIGINT AS file_rank,
        md5({_generated_predict(inf_src)}) AS output_md5 FROM ex"""
    q["collate_bucketed"], q["pack_bucketed"] = q["collate_pad"], q["pack_tokens"]
    block = R.PACK_BLOCK
    cut = {c: f"{c}[chunk * {block} + 1 : least((chunk + 1) * {block}, n)]" for c in ("a", "t", "m")}
    q["pack_unequal"] = with_(EXAMPLES, SFT) + f""", r AS (SELECT conv_id, (row_number() OVER (ORDER BY conv_id) - 1) // {R.PACK_GROUP_ROWS} AS grp,
            list_concat(s, g) AS a, g AS t, list_concat(list_concat(s, g), g) AS m FROM sft_ids),
        g AS (SELECT grp, flatten(list(a ORDER BY conv_id)) AS a, flatten(list(t ORDER BY conv_id)) AS t, flatten(list(m ORDER BY conv_id)) AS m FROM r GROUP BY grp),
        n AS (SELECT *, CASE WHEN len(a) >= {block} THEN len(a) // {block} * {block} WHEN len(a) > 0 THEN {block} ELSE 0 END AS n FROM g),
        k AS (SELECT *, unnest(range(0, n // {block})) AS chunk FROM n)
        SELECT grp::BIGINT AS "group", chunk::BIGINT AS chunk, len({cut['a']})::BIGINT AS n_ids, len({cut['t']})::BIGINT AS n_target,
            len({cut['m']})::BIGINT AS n_more, {checksum(cut['t'])} AS target_checksum, {checksum(cut['m'])} AS more_checksum FROM k"""
    q["generate_resumable"] = q["generate_join"]
    q["shuffle_epochs"] = _epochs(with_(EXAMPLES))
    q["assemble_chunks"] = f"""WITH b AS (SELECT *, coalesce(sum(strlen(role) + strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // {R.TURN_CHUNK_BYTES} AS chunk FROM conversations),
        c AS (SELECT conv_id, chunk, count(*) AS n, string_agg({NL} || role || ': ' || text, '' ORDER BY turn) AS lines FROM b GROUP BY conv_id, chunk),
        t AS (SELECT conv_id, chunk, n, CASE WHEN chunk = 0 THEN {lit(TX.conversation_header)} ELSE '' END || lines AS x FROM c),
        i AS (SELECT *, CASE WHEN chunk = 0 THEN list_prepend(1, {enc('x')}) ELSE {enc('x')} END AS ids FROM t)
        SELECT conv_id, chunk::BIGINT AS chunk, n::BIGINT AS n_turns, md5(x) AS text_md5, len(ids)::BIGINT AS n_tokens, {checksum('ids')} AS ids_checksum FROM i"""
    q["submission_document"] = q["submission_records"]
    q["read_examples_array"] = ex + f"""SELECT conv_id, (row_number() OVER (ORDER BY conv_id) - 1)::BIGINT AS file_pos, n_turns::BIGINT AS n_turns,
        md5({transcript('lines')}) AS transcript_md5, {kw_text('kws')} AS keywords, md5(output) AS output_md5, 'conversations' AS source FROM ex"""
    q["cached_computations"] = ex + """SELECT 'even' AS part, conv_id, md5(output) AS output_md5, true AS reused FROM ex WHERE conv_id % 2 = 0
        UNION ALL SELECT 'third', conv_id, md5(output), true FROM ex WHERE conv_id % 3 = 0"""
    q["stream_prompts"] = sft + f"SELECT conv_id, len(s)::BIGINT AS n_source, {checksum('list_concat(s, g)')} AS ids_checksum FROM sft_ids"
    return q


ORACLE: dict[str, str] = build()
