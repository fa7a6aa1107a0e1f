"""DuckDB SQL with the rows of the operators that SQL can express."""

SQL: dict[str, str] = {
    "op2_minhash_near_dedup": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS x FROM w, LATERAL (SELECT unnest(range(1, greatest(2, len(w)-3))) AS i) WHERE len(w)>0),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x=b.x AND a.doc_id<b.doc_id GROUP BY 1, 2),
 e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id=p.a JOIN n y ON y.doc_id=p.b WHERE 100*c>=85*(x.n+y.n-c)),
 e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
 r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT e2.b, r.c FROM r JOIN e2 ON e2.a=r.a WHERE r.c<e2.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.c) AS component_id, d.doc_id=min(r.c) AS kept FROM documents d JOIN r ON r.a=d.doc_id LEFT JOIN n USING (doc_id) GROUP BY d.doc_id, n.n""",
    "op3_pivot_near_dedup": """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings WHERE embedding IS NOT NULL AND len(embedding)>0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c)))=0),
 e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id<>b.vec_id AND len(a.x)=len(b.x) WHERE a.l>0 AND b.l>0 AND list_inner_product(a.x, b.x)/(a.l*b.l)>=0.9::DOUBLE),
 r AS (SELECT vec_id AS a, vec_id AS c FROM embeddings UNION SELECT e.b, r.c FROM r JOIN e ON e.a=r.a WHERE r.c<e.b)
SELECT vec_id, (SELECT count(*) FROM e WHERE e.a=vec_id) AS n_links, min(c) AS component_id, vec_id=min(c) AS kept FROM embeddings JOIN r ON r.a=vec_id GROUP BY vec_id""",
    "op4_substring_dedup": r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 g AS (SELECT doc_id, i, array_to_string(w[i:i+19], ' ') AS x FROM w, LATERAL (SELECT unnest(range(1, len(w)-18)) AS i)),
 o AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS k FROM g) WHERE k>1),
 c AS (SELECT DISTINCT doc_id, i+j AS p FROM o, (SELECT unnest(range(20)) AS j)),
 k AS (SELECT u.doc_id, string_agg(u.t, ' ' ORDER BY u.p) FILTER (WHERE c.p IS NULL) AS kept, count(c.p) AS gone FROM (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM w) u LEFT JOIN c ON c.doc_id=u.doc_id AND c.p=u.p GROUP BY u.doc_id)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)""",
    "op5_suffix_array_dedup": """WITH h AS (SELECT doc_id, encode(coalesce(text,'')) AS h FROM documents),
 g AS (SELECT doc_id, i, h[i:i+49] AS x FROM h, LATERAL (SELECT unnest(range(1, octet_length(h)-48)) AS i)),
 o AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY x) AS d FROM g) WHERE d<doc_id),
 b AS (SELECT doc_id, i, i-lag(i, 1, -100) OVER (PARTITION BY doc_id ORDER BY i)>50 AS first FROM o),
 s AS (SELECT doc_id, min(i) AS lo, max(i)+50 AS hi FROM (SELECT *, count(*) FILTER (WHERE first) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM b) GROUP BY doc_id, k),
 r AS (SELECT doc_id, lo, hi, lag(hi, 1, 1) OVER (PARTITION BY doc_id ORDER BY lo) AS prev FROM s),
 k AS (SELECT doc_id, string_agg(hex(h[prev:lo-1]), '' ORDER BY lo) AS kept, max(hi) AS tail, sum(hi-lo) AS gone, count(*) AS spans FROM r JOIN h USING (doc_id) GROUP BY doc_id)
SELECT h.doc_id, octet_length(h)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans, sha256(CASE WHEN tail IS NULL THEN h ELSE unhex(kept || hex(h[tail:octet_length(h)])) END) AS kept_sha256 FROM h LEFT JOIN k USING (doc_id)""",
    "op6_warc_revisits": """WITH p AS (SELECT page_id, coalesce(html,'') AS html, sha1(coalesce(html,'')) AS s, min(page_id) OVER (PARTITION BY coalesce(html,'')) AS f FROM pages)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(s, CAST(5*(i//4)+1 AS INTEGER), 5) AS INTEGER) >> CAST(15-5*(i%4) AS INTEGER)) & 31) + 1, 1)), '') AS payload_digest,
 CASE WHEN page_id=f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id<>f THEN f END AS refers_to FROM p""",
    "op11_fill_in_middle": r"""WITH t AS (SELECT doc_id, coalesce(text,'') AS text, regexp_extract_all(coalesce(text,''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id::VARCHAR) AS s FROM documents),
 h AS (SELECT *, len(u) AS n, list_transform(range(4), lambda k: ('0x' || substr(s, CAST(8*k+1 AS INTEGER), 8))::BIGINT) AS h FROM t),
 c AS (SELECT doc_id, text, u, n, least(h[1]%(n+1), h[2]%(n+1)) AS a, greatest(h[1]%(n+1), h[2]%(n+1)) AS b, CASE WHEN text='' OR regexp_matches(text, '<[PSM]>') OR h[3]%100>=90 THEN 'plain' WHEN h[4]%100<20 THEN 'spm' ELSE 'psm' END AS form FROM h),
 p AS (SELECT *, coalesce(array_to_string(u[:a], ''), '') AS pre, coalesce(array_to_string(u[a+1:b], ''), '') AS mid, coalesce(array_to_string(u[b+1:], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form<>'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form<>'plain' THEN length(mid) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
    "op12_merkle_manifest": """WITH RECURSIVE tab AS (SELECT list(v ORDER BY k) AS tab FROM (SELECT k, list_reduce(list_prepend(k, range(8)), lambda x, y: xor(x>>1, 3988292384*(x&1))) AS v FROM range(256) r(k))),
 f AS (SELECT *, CASE WHEN xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda x, c: xor(x>>8, tab[(xor(x,c)&255)+1])))%5=0 THEN translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') ELSE text END AS claim FROM documents, tab),
 e AS (SELECT doc_id, source, concat_ws('', coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head, text, claim FROM f),
 d AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(claim) || ':' || claim, '-')) AS claimed FROM e),
 l AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST)-1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf)-1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d),
 a AS (SELECT 0 AS step, tree, i, n, leaf AS digest FROM l UNION ALL SELECT step+1, tree, i//16, any_value((n+15)//16), sha256(string_agg(digest, '' ORDER BY i)) FROM a WHERE n>1 GROUP BY step, tree, i//16),
 s AS (SELECT tree, digest AS subroot, step AS h FROM a WHERE n=1),
 b AS (SELECT 0 AS step, tree AS i, (SELECT count(*) FROM s) AS n, subroot AS digest FROM s UNION ALL SELECT step+1, i//16, any_value((n+15)//16), sha256(string_agg(digest, '' ORDER BY i)) FROM b WHERE n>1 GROUP BY step, i//16),
 r AS (SELECT digest AS root FROM b WHERE n=1),
 g AS (SELECT step, tree, i//16 AS run, list(digest ORDER BY i) AS ds FROM a WHERE n>1 GROUP BY ALL),
 t AS (SELECT step, i//16 AS run, list(digest ORDER BY i) AS ds FROM b WHERE n>1 GROUP BY ALL),
 x AS (SELECT 0 AS k, doc_id, leaf, l.tree, l.i, 0 AS step, h, claimed AS folded, '' AS proof FROM l JOIN s USING (tree)
  UNION ALL SELECT x.k+1, doc_id, leaf, x.tree, CASE WHEN x.k+1=h THEN x.tree ELSE x.i//16 END, CASE WHEN x.k+1=h THEN 0 ELSE x.step+1 END, h,
   sha256(array_to_string(list_concat(ds[:x.i%16], [folded], ds[x.i%16+2:]), '')), proof || array_to_string(list_concat(ds[:x.i%16], ds[x.i%16+2:]), '')
  FROM (SELECT x.*, coalesce(g.ds, t.ds) AS ds FROM (SELECT k, doc_id, leaf, tree, CASE WHEN k=0 AND h=0 THEN tree ELSE i END AS i, step, h, folded, proof FROM x) x LEFT JOIN g ON x.k<h AND g.step=x.step AND g.tree=x.tree AND g.run=x.i//16 LEFT JOIN t ON x.k>=h AND t.step=x.step AND t.run=x.i//16) x WHERE ds IS NOT NULL),
 z AS (SELECT doc_id, leaf, tree, folded, proof FROM x QUALIFY row_number() OVER (PARTITION BY doc_id, leaf, tree ORDER BY k DESC)=1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded=root AS verified FROM z JOIN s USING (tree), r""",
}
