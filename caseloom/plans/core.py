"""The queries of the engine's own operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import duration_seconds, file_kind, parsed_location, r6
from ..operators import anomaly, chains, compare, dedup, graph, inference, quality, queues, search, stats, store, timeline, weights
from ..session import table
from ..sinks import export
from ..sources import files
from ..streaming import ingest
from .registry import Registry

REGISTRY = Registry()
ALIVE = "not coalesce(is_deleted, false)"
DAY = "case when regexp_matches(associated_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') then try_cast(substr(associated_date, 1, 10) as date) end"
W = "coalesce(severity_score, 0) / 5.0::double * 0.4::double + coalesce(confidence, 0.5::double) * 0.35::double + coalesce(quality_score, 0.5::double) * 0.25::double"
FILES = f"files as (select fingerprint, count(*) co, avg(confidence) mc from facts where {ALIVE} and confidence >= 0 group by 1)"


def q(name: str, sql: str | None, *tables: str):
    """Registers a function of tables."""

    def put(f):
        @REGISTRY.add(name, sql)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*(table(spark, sf_dir, t) for t in tables))

        return f

    return put


q("a1_registry_counts", "select (select count(*) from registry) registered, (select count(*) from registry where processed) processed, (select count(*) from facts) facts, (select count(*) from text_cache) texts", "registry", "facts", "text_cache")(stats.registry_counts)
q("a2_workflow_state", "select count(*) files, count(*) filter (where has_extracted_text) extracted, count(*) filter (where processed) analyzed, max(created_at) last_scan, max(case when has_extracted_text then extracted_at end) last_extraction, max(case when processed then processed_at end) last_analysis, (select count(*) from facts) facts, case when count(*) filter (where processed) > 0 or (select count(*) from facts) > 0 then 'analyzed' when count(*) filter (where has_extracted_text) > 0 then 'extracted' when count(*) > 0 then 'scanned' else 'none' end stage from registry", "registry", "facts")(stats.workflow_state)
q("a3_extraction_statistics", "with t as (select fingerprint, min(file_type) file_type from registry group by 1) select file_type, count(*) texts, coalesce(sum(length(extracted_text)), 0)::bigint characters, round(coalesce(sum(length(extracted_text)) / count(*)::double, 0), 6) mean_characters, round(coalesce(avg(quality_score), 0), 6) mean_quality, count(*) filter (where quality_score < 0.7) partial from text_cache join t using (fingerprint) group by 1", "text_cache", "registry")(stats.extraction_statistics)
q("a4_category_distribution", f"select category, count(*) n, round(avg(severity_score), 6) mean_severity, round(avg(confidence), 6) mean_confidence from facts where {ALIVE} and category is not null group by 1", "facts")(stats.category_distribution)
q("a5_severity_distribution", f"select severity_score, count(*) n from facts where {ALIVE} group by 1", "facts")(stats.severity_distribution)
q("a6_entity_type_distribution", "select lower(entity_type) entity_type, count(distinct value) different_values, count(*) total from entities group by 1", "entities")(stats.entity_type_distribution)
q("a7_overall_statistics", f"select count(*) facts, round(avg(severity_score), 6) mean_severity, round(avg(confidence), 6) mean_confidence, round(avg(quality_score), 6) mean_quality, (select count(*) from entities) entities, (select count(distinct value) from entities) different_entities from facts where {ALIVE}", "facts", "entities")(stats.overall_statistics)
q("a8_date_distribution", f"select strftime({DAY}, '%Y-%m') as month, count(*) n, round(avg(severity_score), 6) mean_severity from facts where {ALIVE} and {DAY} is not null group by 1 order by 1 desc limit 24", "facts")(stats.date_distribution)
q("a16_project_summary", f"select (select count(*) from facts where {ALIVE}) facts, (select least(count(*), 1000) from facts where {ALIVE} and associated_date is not null) timeline_rows, (select count(*) from entities) entities", "facts", "entities")(stats.project_summary)
q("a18_quality_rollup", f"select fingerprint, round(coalesce(avg(confidence), 0), 6) mean_confidence, sum(coalesce(len(people), 0))::bigint people_named, round(avg(case when coalesce(source_quote, '') <> '' then 1.0 else 0.0 end), 6) quoted from facts where {ALIVE} group by 1", "facts")(stats.quality_rollup)
q("a19_by_month", f"with d as (select substr(associated_date, 1, 7) as month, id, coalesce(severity_score, 0) s from facts where {ALIVE} and associated_date is not null), r as (select *, row_number() over (partition by month order by s desc, id) k from d), t as (select month, string_agg(id::varchar, ',' order by k) top_ids from r where k <= 10 group by 1) select month, count(*) n, max(s) top_severity, min(id) first_id, any_value(top_ids) top_ids from d join t using (month) group by 1", "facts")(stats.by_month)
q("facets", f"select 'category' facet, coalesce(category, '') as value, count(*) n from facts where {ALIVE} group by category union all select 'severity', coalesce(severity_score::varchar, ''), count(*) from facts where {ALIVE} group by severity_score union all select 'language', coalesce(source_language, ''), count(*) from facts where {ALIVE} group by source_language", "facts")(stats.facets)

RF = "id, fingerprint, file_name, file_type, processing_priority, last_modified"
RO = "order by processing_priority asc nulls first, last_modified desc nulls last, id"
q("q_unprocessed", f"select {RF} from registry where not coalesce(processed, false) order by id limit 100", "registry")(lambda r: queues.unprocessed(r, 100))
q("q_extraction_queue", f"select {RF} from registry where not coalesce(has_extracted_text, false) {RO} limit 10000", "registry")(lambda r: queues.extraction_queue(r, 10000))
q("q_analysis_queue", f"select {RF} from registry where has_extracted_text and not coalesce(processed, false) {RO} limit 10", "registry")(lambda r: queues.analysis_queue(r, 10))
q("q_priority_queue", f"select {RF} from registry {RO} limit 200", "registry")(lambda r: queues.priority_queue(r, 200))
q("q_listing", f"select id, fact_summary, category, severity_score, created_at from facts where {ALIVE} order by severity_score desc nulls last, created_at desc nulls last, id limit 50 offset 25", "facts")(lambda f: queues.listing(f, 50, 25))
q("q_search_by_tags", f"select id, fact_summary, category, severity_score, 0.0::double as rank from facts where {ALIVE} and (list_contains(list_transform(tags, lambda t: trim(t)), 'fraud') or list_contains(list_transform(tags, lambda t: trim(t)), 'bank')) order by id limit 200", "facts")(lambda f: queues.search_by_tags(f, ["fraud", "bank"], False, 200))
q("q_search_by_all_tags", f"select id, fact_summary, category, severity_score, 0.0::double as rank from facts where {ALIVE} and list_contains(list_transform(tags, lambda t: trim(t)), 'fraud') and list_contains(list_transform(tags, lambda t: trim(t)), 'key') order by id limit 200", "facts")(lambda f: queues.search_by_tags(f, ["fraud", "key"], True, 200))
q("q_all_tags", "select tag, count(*) n from (select distinct id, trim(t) tag from (select id, unnest(tags) t from facts)) where tag <> '' group by 1", "facts")(queues.all_tags)
q("q_tag_added", "select id, list_distinct(list_concat(list_filter(list_transform(coalesce(tags, []), lambda t: trim(t)), lambda t: t <> ''), ['review'])).list_sort().array_to_string(',') as tags from facts", "facts")(lambda f: f.select("id", F.array_join(F.array_sort(queues.tag_added(F.col("tags"), "review")), ",").alias("tags")))
q("q_result_filter", f"select id, fact_summary, category, severity_score, created_at from facts where {ALIVE} and (contains(lower(fact_summary), 'payment') or contains(lower(category), 'payment') or contains(lower(identified_crime), 'payment')) order by severity_score desc nulls last, id limit 500", "facts")(lambda f: queues.result_filter(f, "payment"))
q("q_severity_bands", "select case when severity_score >= 8 then 'critical' when severity_score >= 6 then 'high' when severity_score >= 4 then 'medium' else 'low' end band, count(*) n from facts group by 1", "facts")(lambda f: f.groupBy(queues.severity_band(F.col("severity_score")).alias("band")).agg(F.count(F.lit(1)).alias("n")))
q("q_lookup", "select id, fingerprint, path from registry where id = 7", "registry")(lambda r: queues.by_key(r.select("id", "fingerprint", "path"), "id", 7))
q("q_fingerprints", "select distinct fingerprint from registry", "registry")(lambda r: r.select("fingerprint").distinct())
q("j1_text_with_file", "select t.id, r.path, length(t.extracted_text) n from text_cache t join registry r using (fingerprint)", "text_cache", "registry")(lambda t, r: t.select("id", "fingerprint", F.length("extracted_text").alias("n")).join(r.select("fingerprint", "path"), "fingerprint").select("id", "path", F.col("n").cast("long").alias("n")))
q("s_file_kinds", "select path, case when e in ('pdf') then 'pdf' when e in ('jpg','jpeg','png','bmp','tiff','tif') then 'image' when e in ('mp3','wav','m4a','ogg','flac') then 'audio' when e in ('mp4','m4v') then 'video' when e in ('docx','doc') then 'docx' when e in ('txt','md','json','xml','csv','rtf') then 'text' else 'unknown' end kind from (select path, lower(regexp_extract(path, '\\.([^./]+)$', 1)) e from registry)", "registry")(lambda r: r.select("path", file_kind(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("kind")))
q("s_durations", "select id, round(file_size * 8 / (case when lower(file_name) like '%.wav' then 1411 when lower(file_name) like '%.flac' then 800 else 128 end * 1000.0::double), 9) as seconds from registry where file_type = 'audio' and file_size is not null", "registry")(lambda r: r.filter("file_type = 'audio' and file_size is not null").select("id", F.round(duration_seconds(F.col("file_size"), F.regexp_extract("file_name", r"\.([^./]+)$", 1)), 9).alias("seconds")))
q("s_text_hashes", "select doc_id, sha256(text) hash, sha256(text) = text_hash as same from documents where text is not null", "documents")(lambda d: d.filter("text is not null").select("doc_id", F.sha2("text", 256).alias("hash"), (F.sha2("text", 256) == F.col("text_hash")).alias("same")))
q("s_change_priority", "select path, case when processed is null and has_extracted_text is null then 0 when last_modified > timestamp '2022-10-01' then 1 when coalesce(has_extracted_text, false) and not coalesce(processed, false) then 2 else 3 end priority from registry", "registry")(lambda r: r.select("path", F.when(F.col("processed").isNull() & F.col("has_extracted_text").isNull(), 0).when(F.col("last_modified") > F.lit("2022-10-01").cast("timestamp_ntz"), 1).when(F.coalesce("has_extracted_text", F.lit(False)) & ~F.coalesce("processed", F.lit(False)), 2).otherwise(3).alias("priority")))
q("w_insert_ignore", "select fingerprint, min_by(path, id) path from registry where fingerprint not in (select fingerprint from text_cache) group by 1", "registry", "text_cache")(lambda r, t: store.insert_ignore(t, r.select("id", "fingerprint", "path"), ["fingerprint"], "id").select("fingerprint", "path"))
q("w_latest_text", "select fingerprint, max(id) id from text_cache group by 1", "text_cache")(lambda t: store.latest(t.select("id", "fingerprint"), ["fingerprint"], "id").select("fingerprint", "id"))
q("w_latest_facts", "select fingerprint, filename, fact_summary, max(id) id from facts group by 1, 2, 3", "facts")(lambda f: store.latest(f.select("id", "fingerprint", "filename", "fact_summary"), ["fingerprint", "filename", "fact_summary"], "id"))
q("w_upsert", "select fingerprint, min_by(path, id) path, min_by(file_type, id) file_type from registry where fingerprint not in (select fingerprint from text_cache) group by 1 union all select fingerprint, max_by(file_name, id), null from text_cache group by 1", "registry", "text_cache")(lambda r, t: store.upsert(r.groupBy("fingerprint").agg(F.min_by("path", "id").alias("path"), F.min_by("file_type", "id").alias("file_type")), t.select("fingerprint", F.col("file_name").alias("path"), F.col("id").alias("seq")), ["fingerprint"]))

q("t1_timeline", f"select id, associated_date, fact_summary, category, severity_score from facts where {ALIVE} and associated_date >= '2015' and associated_date <= '2020-12-31' order by associated_date, id limit 1000", "facts")(lambda f: timeline.events(f, "2015", "2020-12-31"))
q("t3_clusters", f"with recursive d as (select {DAY} as day, count(*) n, max(severity_score) s from facts where {ALIVE} and {DAY} is not null group by 1), r(day, start) as (select min(day), min(day) from d union all select x.day, case when x.day - r.start > 7 then x.day else r.start end from r, lateral (select min(day) as day from d where d.day > r.day) x where x.day is not null) select start cluster_start, max(r.day) cluster_end, sum(n)::bigint n, max(s) top_severity, count(*) as days from r join d on r.day = d.day group by 1", "facts")(lambda f: timeline.clusters(f, 7))
q("t4_temporal_anomalies", f"with d as (select {DAY} as day, count(*) n, avg(severity_score) m from facts where {ALIVE} and {DAY} is not null group by 1), w as (select day, n, coalesce(avg(m) over (order by day rows between 5 preceding and 4 following), 0) l, (n - avg(n) over ()) / nullif(stddev_pop(n) over (), 0) z from d) select day, n, round(l, 6) local_severity, round(z, 6) deviation from w where l > 5", "facts")(lambda f: timeline.anomalies(f, 5, 5.0))
q("t5_hours", f"select hour(created_at)::int as hour, count(*) n from facts where {ALIVE} and created_at is not null group by 1", "facts")(timeline.hour_pattern)
q("t5_date_consistency", f"with d as (select fingerprint, {DAY} as day, created_at::date made from facts where {ALIVE}) select fingerprint, count(*) dated, count(*) filter (where day > made) after_record, round(avg(case when day <= made then 1.0 else 0.0 end), 6) consistency from d where day is not null and made is not null group by 1", "facts")(timeline.date_consistency)

q("g1_relationships", f"with {FILES}, r as (select fingerprint, co, mc from files where fingerprint in (select fingerprint from entities group by 1 having count(*) > 1)), t as (select r.* from r join (select fingerprint, min(id) m from entities group by 1) using (fingerprint) order by co desc, m limit 100), e as (select e.id, e.fingerprint, co, mc from entities e join t using (fingerprint)) select x.id a, y.id b, x.co cooccurrence, round(x.mc, 6) mean_confidence from e x join e y on x.fingerprint = y.fingerprint and x.id < y.id order by cooccurrence desc, a, b limit 100", "facts", "entities")(lambda f, e: graph.relationships(f, e))
q("g1_relationships_of", f"with {FILES} select least(o.id, x.id) a, greatest(o.id, x.id) b, co cooccurrence, round(mc, 6) mean_confidence from entities o join files using (fingerprint) join entities x on x.fingerprint = o.fingerprint and x.id <> o.id where o.id = 9 order by cooccurrence desc, a, b limit 100", "facts", "entities")(lambda f, e: graph.relationships(f, e, 9))
q("g2_connected", f"with {FILES} select x.id, x.value, 1 distance from entities x where x.fingerprint in (select fingerprint from files) and x.fingerprint in (select fingerprint from entities where id = 9) and x.id <> 9", "facts", "entities")(lambda f, e: graph.connected(f, e, 9))
q("g3_centrality", f"with f as (select fingerprint, count(*) co from facts where {ALIVE} and confidence >= 0 group by 1), t as (select id, value, lower(entity_type) entity_type, co occurrences, round(confidence, 6) confidence from entities join f using (fingerprint) where confidence >= 0.5 order by occurrences desc, id limit 50) select *, round(occurrences / max(occurrences) over ()::double, 6) centrality from t", "facts", "entities")(lambda f, e: graph.centrality(f, e, None, 0.5))
q("g3_value_centrality", f"with f as (select fingerprint, count(*) co from facts where {ALIVE} and confidence >= 0 group by 1), t as (select entity_type, value, count(*) files, sum(co)::bigint occurrences from (select distinct lower(entity_type) entity_type, value, fingerprint from entities where confidence >= 0 and value is not null) join f using (fingerprint) group by 1, 2 order by occurrences desc, entity_type, value limit 50) select *, round(occurrences / max(occurrences) over ()::double, 6) centrality from t", "facts", "entities")(graph.value_centrality)
PEOPLE = f"p as (select distinct id, trim(x) p from (select id, unnest(people) x from facts where {ALIVE}) where trim(x) <> ''), e as (select a.p a, b.p b, count(*) n from p a join p b on a.id = b.id and a.p < b.p group by 1, 2)"
q("g5_people_pairs", f"with {PEOPLE} select a, b, n, round(least(n / (select count(*) from facts where {ALIVE})::double, 1.0), 6) strength from e", "facts")(graph.people_pairs)
q("g4_nodes", f"with {PEOPLE}, n as (select a node from e union select b from e) select node, case when length(node) > 15 then substr(node, 1, 15) || '...' else node end as label from n", "facts")(lambda f: graph.nodes(graph.people_pairs(f)))
q("g7_degrees", f"with {PEOPLE}, d as (select node, count(distinct o) degree from (select a node, b o from e union all select b, a from e) group by 1) select node, degree, round(coalesce(degree / nullif((select count(*) from d) - 1, 0)::double, 0), 6) centrality from d", "facts")(lambda f: graph.degrees(graph.people_pairs(f)))
q("g8_betweenness", None, "facts")(lambda f: graph.betweenness(graph.people_pairs(f)))
q("g8_betweenness_sampled", None, "facts")(lambda f: graph.betweenness(graph.people_pairs(f), sources=256))
q("g9_communities", None, "facts")(lambda f: graph.communities(graph.people_pairs(f)))
q("g10_clustering", f"with {PEOPLE}, u as (select a, b from e), d as (select node, count(*) degree from (select a node from u union all select b from u) group by 1), t as (select x.a p, x.b q, y.b r from u x join u y on x.b = y.a join u z on z.a = x.a and z.b = y.b), c as (select node, count(*) k from (select p node from t union all select q from t union all select r from t) group by 1) select node, degree, coalesce(k, 0) triangles, round(coalesce(2 * coalesce(k, 0) / nullif(degree * (degree - 1), 0)::double, 0), 6) clustering from d left join c using (node)", "facts")(lambda f: graph.clustering(graph.people_pairs(f)))
q("g12_alias_matches", None, "entities")(graph.alias_matches)
q("g13_locations", f"with {FILES}, l as (select id, value, confidence, regexp_extract(coalesce(normalized_value, value), '(-?[0-9]+\\.?[0-9]*)[,\\s]+(-?[0-9]+\\.?[0-9]*)', ['a', 'b']) m from entities where lower(entity_type) = 'location' and confidence >= 0 and fingerprint in (select fingerprint from files)), c as (select id, value, confidence, try_cast(m.a as double) a, try_cast(m.b as double) b from l) select id, value, confidence, case when a between -90 and 90 and b between -180 and 180 then a end lat, case when a between -90 and 90 and b between -180 and 180 then b end lon from c order by confidence desc, id limit 100", "facts", "entities")(graph.locations)
q("g14_parsed_locations", "with l as (select id, regexp_extract(value, '(-?[0-9]+\\.?[0-9]*)[,\\s]+(-?[0-9]+\\.?[0-9]*)', ['a', 'b']) m from entities), c as (select id, try_cast(m.a as double) a, try_cast(m.b as double) b from l) select id, a lat, b lon from c where a between -90 and 90 and b between -180 and 180", "entities")(lambda e: e.select("id", parsed_location("value").alias("p")).filter("p is not null").select("id", "p.lat", "p.lon"))
PLACES = "p as (select id, try_cast(m.a as double) lat, try_cast(m.b as double) lon from (select id, regexp_extract(value, '(-?[0-9]+\\.?[0-9]*)[,\\s]+(-?[0-9]+\\.?[0-9]*)', ['a', 'b']) m from entities where lower(entity_type) = 'location')), v as (select * from p where lat between -90 and 90 and lon between -180 and 180)"
q("g15_nearby", f"with {PLACES}, d as (select a.id id_a, b.id id_b, 2 * 6371.0088 * asin(least(sqrt(pow(sin(radians((a.lat - b.lat) / 2)), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians((a.lon - b.lon) / 2)), 2)), 1)) km from v a join v b on a.id < b.id) select id_a, id_b, round(km, 3) km from d where km <= 500", "entities")(lambda e: graph.nearby(e.filter("lower(entity_type) = 'location'").select("id", parsed_location("value").alias("p")).filter("p is not null").select("id", "p.lat", "p.lon"), 500.0))

LEAST_Z = {"severity": 2.0, "confidence": 2.0, "quality": 1.5}  # qualities are spread evenly: none lies two deviations out
for metric, column in anomaly.METRICS.items():
    q(f"n1_{metric}_anomalies", f"with s as (select avg({column}::double) m, stddev_pop({column}::double) sd from facts where {ALIVE} and {column} is not null) select id, {column}::double as value, round(m, 6) mean, round(({column} - m) / nullif(sd, 0), 6) z from facts, s where {ALIVE} and abs(({column} - m) / nullif(sd, 0)) > {LEAST_Z[metric]}", "facts")(lambda f, metric=metric: anomaly.fact_anomalies(f, metric, LEAST_Z[metric]))
q("n2_size_anomalies", "with s as (select avg(file_size::double) m, stddev_pop(file_size::double) sd from registry) select id, file_size::double as value, round(m, 6) mean, round((file_size - m) / nullif(sd, 0), 6) z, round(least(abs(round((file_size - m) / nullif(sd, 0), 6)) / 5.0, 1.0), 6) score from registry, s where abs((file_size - m) / nullif(sd, 0)) > 2.5", "registry")(anomaly.size_anomalies)
q("n3_severity_outliers", f"with b as (select id, fingerprint, severity_score v from facts where {ALIVE} and severity_score is not null), g as (select fingerprint, list_sort(list(v)) l, count(*) n from b group by 1 having count(*) >= 4), f as (select fingerprint, greatest(trunc(l[n // 4 + 1] - 1.5 * (l[3 * n // 4 + 1] - l[n // 4 + 1])), 0)::int low, least(trunc(l[3 * n // 4 + 1] + 1.5 * (l[3 * n // 4 + 1] - l[n // 4 + 1])), 10)::int high from g) select id, v severity_score, low, high, round(least(greatest(low - v, v - high) / 5.0::double, 1.0), 6) score from b join f using (fingerprint) where v < low or v > high", "facts")(anomaly.severity_outliers)
q("n4_repeated_hashes", "select evidence_hash, count(*) n, round(least(count(*) / 20.0::double, 1.0), 6) score from facts where evidence_hash is not null group by 1 having count(*) > 1", "facts")(lambda f: anomaly.repeated_hashes(f, 1))
q("n4_frequent_pairs", f"with p as (select distinct id, trim(x) p from (select id, unnest(tags) x from facts where {ALIVE}) where trim(x) <> ''), e as (select a.p a, b.p b, count(*) n from p a join p b on a.id = b.id and a.p < b.p group by 1, 2), m as (select avg(n) m from e) select a, b, n, round(least(n / (5 * m), 1.0), 6) score from e, m where n > 1.1 * m", "facts")(lambda f: anomaly.frequent_pairs(graph.people_pairs(f.withColumn("people", F.col("tags"))), 1.1))
q("n6_weighted_evidence", f"select id, fingerprint, filename, fact_summary, category, severity_score, confidence, quality_score, round({W}, 6) weight, created_at from facts where {ALIVE} and {W} >= 0.5 order by weight desc, id limit 1000", "facts")(lambda f: weights.weighted(f, 0.5, 1000))
q("n8_corroboration", f"select trim(regexp_replace(lower(fact_summary), '\\s+', ' ', 'g')) summary, count(distinct fingerprint) sources, count(*) facts, coalesce(max(severity_score) - min(severity_score), 0) >= 5 contradicted from facts where {ALIVE} and fact_summary is not null group by 1 having count(distinct fingerprint) >= 2", "facts")(weights.corroboration)
q("n9_quote_checks", f"select f.id, max(contains(extracted_text, source_quote)::int)::boolean as found, coalesce(any_value(contains(lower(source_quote), lower(fact_summary))), false) as holds_summary from facts f join text_cache t using (fingerprint) where {ALIVE} and coalesce(source_quote, '') <> '' and extracted_text is not null group by 1", "facts", "text_cache")(weights.quote_checks)

TOP = f"t as (select id, fingerprint, round({W}, 6) weight from facts where {ALIVE} and {W} >= 0.6 order by weight desc, id limit 1000), v as (select distinct fingerprint, value from entities where value is not null and fingerprint in (select fingerprint from t)), o as (select a.fingerprint f, b.fingerprint g, count(*) n from v a join v b on a.value = b.value group by 1, 2 having count(*) >= 2)"
q("c1_chains", f"with {TOP}, r as (select t.id, t.fingerprint, t.weight, count(*) - 1 * max((u.fingerprint = t.fingerprint)::int) related from t join o on o.f = t.fingerprint join t u on u.fingerprint = o.g group by 1, 2, 3) select id, fingerprint, weight, related from r where related >= 2", "facts", "entities")(lambda f, e: chains.detect(f, e, 0.6, 2))
q("c1_related_facts", f"with v as (select distinct value from entities where value is not null and fingerprint in (select fingerprint from facts where id = 2)), o as (select fingerprint, count(distinct value) overlap from entities where value in (select value from v) group by 1) select id, fingerprint, overlap from facts join o using (fingerprint) where {ALIVE} and id <> 2 order by overlap desc, id limit 100", "facts", "entities")(lambda f, e: chains.related_facts(f, e, 2))
q("c2_by_entities", f"with h as (select fingerprint, string_agg(distinct value, ',' order by value) named, count(distinct value) n from entities where value in ('Ostwick', 'Caldness', 'Norwick') group by 1 having count(distinct value) >= 1) select id, fingerprint, named, n from facts join h using (fingerprint) where {ALIVE}", "facts", "entities")(lambda f, e: chains.by_entities(f, e, ["Ostwick", "Caldness", "Norwick"], 1))
q("c3_suggestions", f"with r as (select fingerprint rf, category rc, severity_score rs, list_filter(regexp_split_to_array(lower(trim(fact_summary)), '\\s+'), lambda w: strlen(w) > 4)[1:10] w from facts where id = 2), c as (select id, category, severity_score, rc, rs, len(w) k, len(list_filter(w, lambda x: contains(lower(coalesce(fact_summary, '')), x))) h from facts, r where {ALIVE} and fingerprint <> rf), t as (select * from c where h > 0 order by severity_score desc nulls last, id limit 20), s as (select id, h, round(0.7 * h / k + case when category is not distinct from rc then 0.2 else 0.0 end + case when abs(severity_score - rs) <= 1 then 0.1 else 0.0 end, 6) s from t) select id, s::double similarity, h || ' keyword matches' reasons from s where s >= 0.3", "facts")(lambda f: chains.suggestions(f, 2, 0.3))
HALF1, HALF2 = "left(fingerprint, 1) < '8'", "left(fingerprint, 1) >= '8'"
CASES = f"f1 as (select * from facts where {HALF1}), f2 as (select * from facts where {HALF2}), e1 as (select * from entities where {HALF1}), e2 as (select * from entities where {HALF2})"


def halves(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    first = F.substring("fingerprint", 1, 1) < "8"
    return df.filter(first), df.filter(~first)


q("c5_shared_entities", f"with {CASES}, p1 as (select value, sum(co)::bigint n1, min(lower(entity_type)) t from e1 join (select fingerprint, count(*) co from f1 where {ALIVE} and confidence >= 0 group by 1) using (fingerprint) where value is not null group by 1), p2 as (select value, sum(co)::bigint n2 from e2 join (select fingerprint, count(*) co from f2 where {ALIVE} and confidence >= 0 group by 1) using (fingerprint) where value is not null group by 1) select value, t entity_type, n1, n2 from p1 join p2 using (value)", "facts", "entities")(lambda f, e: compare.shared_entities(halves(f)[0], halves(e)[0], halves(f)[1], halves(e)[1]))
q("c5_date_correlation", f"with {CASES}, a as (select distinct associated_date d from f1 where {ALIVE} and associated_date is not null), b as (select distinct associated_date d from f2 where {ALIVE} and associated_date is not null) select (select count(*) from a join b using (d)) aligned, (select count(*) from (select d from a union select d from b)) either, (select min(d) from a) first1, (select max(d) from a) last1, (select min(d) from b) first2, (select max(d) from b) last2, round((select count(*) from a join b using (d)) / nullif((select count(*) from (select d from a union select d from b)), 0)::double, 6) correlation", "facts")(lambda f: compare.date_correlation(*halves(f)))
q("c5_entity_similarity", f"with {CASES}, a as (select distinct value from e1 where value is not null), b as (select distinct value from e2 where value is not null) select (select count(*) from a) n1, (select count(*) from b) n2, (select count(*) from a join b using (value)) common, round(2 * (select count(*) from a join b using (value)) / nullif((select count(*) from a) + (select count(*) from b), 0)::double, 6) dice", "entities")(lambda e: compare.entity_similarity(*halves(e)))
q("c6_across_cases", f"with {CASES} select value, string_agg(distinct c, ',' order by c) cases, count(distinct c) n from (select 'one' c, value from e1 union all select 'two', value from e2) where value is not null group by 1 having count(distinct c) >= 2", "entities")(lambda e: compare.across(dict(zip(("one", "two"), halves(e)))))
q("c6_matching_facts", f"with {CASES}, a as (select trim(regexp_replace(lower(fact_summary), '\\s+', ' ', 'g')) summary, count(*) n1 from f1 where {ALIVE} and fact_summary is not null group by 1), b as (select trim(regexp_replace(lower(fact_summary), '\\s+', ' ', 'g')) summary, count(*) n2 from f2 where {ALIVE} and fact_summary is not null group by 1) select summary, n1, n2 from a join b using (summary)", "facts")(lambda f: compare.matching_facts(*halves(f)))
# in the order of ids, a set follows the first earlier set near it that doesn't follow another
GREEDY = r"s as (select id, coalesce(associated_date, chr(1)) d, coalesce(category, chr(1)) k, list_sort(list_distinct(list_filter(regexp_split_to_array(trim(lower(coalesce(fact_summary, ''))), '\s+'), lambda x: x <> ''))) w from facts), p as (select d, k, w, min(id) id, len(w) n from s where len(w) > 0 group by 1, 2, 3), e as (select a.id a, b.id b from p a join p b on a.d = b.d and a.k = b.k and a.id < b.id and a.n * 0.85 <= b.n and b.n * 0.85 <= a.n where len(list_intersect(a.w, b.w))::double / (a.n + b.n - len(list_intersect(a.w, b.w))) >= 0.85), o as (select b, list(a) before, row_number() over (order by b) step from e group by 1), g(step, followers) as (select 0::bigint, []::bigint[] union all select o.step, case when len(list_filter(o.before, lambda x: not list_contains(g.followers, x))) > 0 then list_append(g.followers, o.b) else g.followers end from g join o on o.step = g.step + 1), f as (select followers from g order by step desc limit 1), l as (select o.b id, list_min(list_filter(o.before, lambda x: not list_contains(f.followers, x))) leader from o, f where list_contains(f.followers, o.b)), q as (select s.id, case when len(s.w) = 0 then s.id else coalesce(l.leader, p.id) end leader from s left join p on p.d = s.d and p.k = s.k and p.w = s.w left join l on l.id = p.id)"
q("c7_dedup_groups", f"with recursive {GREEDY} select id, leader from q", "facts")(lambda f: dedup.groups(f))
q("c8_merged", f"with recursive {GREEDY}, m as (select leader, arg_max(id, [coalesce(severity_score, -1), -id]) id from q join facts using (id) group by 1) select leader, id, fact_summary, associated_date, category, identified_crime, severity_score, confidence from m join facts using (id)", "facts")(lambda f: dedup.merged(f, dedup.groups(f), "most_severe"))
q("c8_merged_all", f"with recursive {GREEDY} select leader, array_to_string(list_sort(list_distinct(list(fact_summary) filter (where fact_summary is not null))), '; ') fact_summary, min_by(associated_date, id) filter (where associated_date is not null) associated_date, min_by(category, id) filter (where category is not null) category, min_by(identified_crime, id) filter (where identified_crime is not null) identified_crime, max(severity_score) severity_score, max(confidence) confidence from q join facts using (id) group by 1", "facts")(lambda f: dedup.merged(f, dedup.groups(f), "merge_all"))
q("c9_exact_dedup", "select raw_id, source, summary from llm_facts qualify row_number() over (partition by source, summary order by raw_id) = 1", "llm_facts")(lambda x: dedup.exact(x.select("raw_id", "source", "summary"), "raw_id", ["source", "summary"]))
q("c10_fact_quality", f"with f as (select id, least(greatest(coalesce(confidence, 0), 0), 1)::double c, greatest(strlen(coalesce(evidence_full, source_quote, '')), 1) src, strlen(coalesce(fact_summary, '')) s, strlen(coalesce(source_quote, '')) qn, coalesce(len(people), 0) p from facts where {ALIVE}), g as (select *, least(s / src::double, 1) cov, 1000.0::double * p / src den, coalesce(least(qn / nullif(s, 0)::double, 1), 0) quo from f), h as (select *, round(0.4::double * c + 0.2::double * cov + 0.2::double * least(den, 10) / 10 + 0.2::double * quo, 6) o from g) select id, o overall, case when o >= 0.7 then 'Good' when o >= 0.4 then 'Marginal' else 'Poor' end as level, array_to_string(list_filter([case when c < 0.5 then 'LowConfidence' end, case when qn < 10 then 'ShortQuote' end, case when cov < 0.1 then 'PoorCoverage' end, case when s > 0 and p = 0 then 'EntityMismatch' end], lambda x: x is not null), ',') issues, o < 0.5 or c < 0.5 or cov < 0.1 as retry from h", "facts")(quality.fact_quality)
q("c12_text_quality", "with t as (select id, coalesce(extracted_text, '') t, strlen(coalesce(extracted_text, '')) n from text_cache), w as (select id, n, len(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '')) k, length(regexp_replace(t, '\\s+', '', 'g')) ch, not regexp_matches(t, '[^\\s[:punct:]]') blank from t) select id, round(case when n < 100 then 0.3::double when n < 500 then 0.7::double else 1.0::double end * case when n < 50 or blank then 0.2::double else 1.0::double end * case when k > 0 and ch / k::double > 20 then 0.5::double else 1.0::double end, 6) confidence, n < 50 or blank as scanned, k::int words from w", "text_cache")(lambda t: quality.text_quality(t, "id", "extracted_text"))


def bm25(columns: list[str], terms: list[str], source: str, counts: list[str] | None = None) -> str:
    """Common table expressions of which r is the source with counts f0, f1, ... of the terms and rank. counts: how to count each instead."""
    toks = [f"list_filter(string_split(regexp_replace(strip_accents(lower(coalesce({c}, ''))), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '')" for c in columns]
    f = counts or [" + ".join(f"len(list_filter({t}, lambda x: x = '{w}'))" for t in toks) for w in terms]
    d = " + ".join(f"len({t})" for t in toks)
    idf = [f"(select case when ln((n - n{k} + 0.5) / (n{k} + 0.5)) <= 0 then 1e-6 else ln((n - n{k} + 0.5) / (n{k} + 0.5)) end from s)" for k in range(len(f))]
    score = " + ".join(f"{i} * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * d / (select a from s)))" for k, i in enumerate(idf))
    return f"with x as (select *, {', '.join(f'{e} f{k}' for k, e in enumerate(f))}, {d} d from {source}), s as (select count(*) n, avg(d) a, {', '.join(f'count(*) filter (where f{k} > 0) n{k}' for k in range(len(f)))} from x), r as (select *, round(-({score}), 6) as rank from x)"


def folded(c: str) -> str:
    return f"list_filter(string_split(regexp_replace(strip_accents(lower(coalesce({c}, ''))), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '')"


def phrase_count(columns: list[str], a: str, b: str) -> str:
    return " + ".join(f"len(list_filter(range(1, len({folded(c)})), lambda i: ({folded(c)})[i] = '{a}' and ({folded(c)})[i + 1] = '{b}'))" for c in columns)


def prefix_count(columns: list[str], head: str) -> str:
    return " + ".join(f"len(list_filter({folded(c)}, lambda x: starts_with(x, '{head}')))" for c in columns)


FACTS_ALIVE = f"(select * from facts where {ALIVE})"
q("f1_search_facts", bm25(search.FACT_COLUMNS, ["scanner", "recording"], FACTS_ALIVE) + " select id, filename, fact_summary, category, severity_score, rank from r where f0 > 0 or f1 > 0 order by rank, id limit 100", "facts")(lambda f: search.facts(f, "scanner OR recording"))
q("f2_search_facts_filtered", bm25(search.FACT_COLUMNS, ["payment", "plumber", "archive"], FACTS_ALIVE) + " select id, filename, fact_summary, category, severity_score, rank from r where f0 > 0 and (f1 > 0 or f2 > 0) and severity_score >= 3 and category in ('financial', 'legal', 'activity') and associated_date >= '2010' order by rank, id limit 50", "facts")(lambda f: search.facts(f, "payment AND (plumber OR archive)", 50, ["financial", "legal", "activity"], 3, "2010"))
q("f2_search_facts_not", bm25(search.FACT_COLUMNS, ["scanner", "payment"], FACTS_ALIVE) + " select id, filename, fact_summary, category, severity_score, rank from r where f0 > 0 and not f1 > 0 order by rank, id limit 100", "facts")(lambda f: search.facts(f, "scanner NOT payment"))
q("f2_search_phrase", bm25(search.FACT_COLUMNS, [], FACTS_ALIVE, [phrase_count(search.FACT_COLUMNS, "second", "signature"), prefix_count(search.FACT_COLUMNS, "cross")]) + " select id, filename, fact_summary, category, severity_score, rank from r where f0 > 0 and f1 > 0 order by rank, id limit 100", "facts")(lambda f: search.facts(f, '"second signature" AND cross*'))
q("f3_search_entities", bm25(search.ENTITY_COLUMNS, ["logistics"], "entities") + " select id, value, normalized_value, lower(entity_type) entity_type, confidence, rank from r where f0 > 0 and lower(entity_type) = 'organization' and confidence >= 0.5 order by rank, id limit 100", "entities")(lambda e: search.entities(e, "logistics", 100, ["ORGANIZATION"], 0.5))
q("f4_search_combined", f"with a as ({bm25(search.FACT_COLUMNS, ['timber', 'scanner'], FACTS_ALIVE)} select 'fact' kind, id, fact_summary title, null::varchar description, category, severity_score, rank from r where f0 > 0 or f1 > 0 order by rank, id limit 50), b as ({bm25(search.ENTITY_COLUMNS, ['timber', 'scanner'], 'entities')} select 'entity' kind, id, value title, normalized_value description, lower(entity_type) category, null::int severity_score, rank from r where f0 > 0 or f1 > 0 order by rank, id limit 50) select * from (select * from a union all select * from b) order by rank, kind, id limit 50", "facts", "entities")(lambda f, e: search.combined(f, e, "timber OR scanner"))
q("f3_entity_facts", f"with n as (select fingerprint, min(filename) filename from facts where {ALIVE} group by 1), h as ({bm25(search.ENTITY_COLUMNS, ['logistics'], 'entities')} select id, value, fingerprint, rank from r where f0 > 0) select id, value, filename, rank from h join n using (fingerprint) order by rank, id limit 100", "entities", "facts")(lambda e, f: search.entity_facts(e, f, "logistics"))
q("f7_postings", " union all ".join(f"select '{c}' as column, term, id doc, count(*)::bigint tf, list_sort(list(pos)).list_transform(lambda x: x::int) positions from (select id, unnest(t) term, unnest(range(len(t))) pos from (select id, {folded(c)} t from facts)) group by 2, 3" for c in search.FACT_COLUMNS), "facts")(lambda f: search.postings(f, "id", search.FACT_COLUMNS))

q("u1_chunks", "with t as (select id, file_name, extracted_text t, length(extracted_text) n from text_cache where extracted_text <> ''), l as (select *, case when n <= 2000 then 0 else ceil((n - 2000) / 1850.0)::int end m from t), c as (select *, unnest(range(m + 1))::int k from l) select id, k chunk_no, case when k = 0 then file_name else coalesce(file_name, '') || ' (Part ' || (k + 1) || '/' || (m + 1) || ')' end as label, substr(t, k * 1850 + 1, 2000) chunk from c", "text_cache")(lambda t: inference.chunks(t, "id", "file_name", "extracted_text"))
q("u6_parse_facts", "select raw_id id, coalesce(source, 'unknown') source, coalesce(summary, 'No summary') summary, coalesce(category, 'other') category, coalesce(severity, 1) severity, len(coalesce(people, []))::int people from llm_facts", "llm_facts")(
    lambda x: inference.parse_facts(x.select(F.col("raw_id").alias("id"), F.lit(0).alias("chunk_no"), F.lit("unknown").alias("label"), F.to_json(F.array(F.struct(*[c for c in x.columns if c != "raw_id"]))).alias("output"))).select("id", "source", "summary", "category", "severity", F.size("people").alias("people"))
)
q("u8_entity_counts", "select raw_id, coalesce(len(people), 0)::int n from llm_facts", "llm_facts")(lambda x: x.select("raw_id", inference.entity_count(F.to_json(F.struct(F.coalesce("people", F.array().cast("array<string>")).alias("entities")))).alias("n")))
q("u14_languages", "with w as (select doc_id, text, regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}]+') w from documents), n as (select doc_id, text, greatest(" + ", ".join(f"row(len(list_filter(w, lambda x: list_contains({x.split()!r}, x))), '{c}')" for c, x in inference.COMMON_WORDS.items()) + ") b from w) select doc_id, case when regexp_matches(text, '[\u3040-\u30ff]') then 'ja' when b[1] > 0 then b[2] end as language from n", "documents")(lambda d: d.select("doc_id", inference.language(F.col("text")).alias("language")))
q("derived_entities", f"select distinct id intelligence_id, fingerprint, entity_type, value, lower(value) normalized_value, confidence from (select id, fingerprint, 'person' entity_type, trim(x) as value, confidence from (select id, fingerprint, confidence, unnest(people) x from facts) union all select id, fingerprint, 'location', trim(location), confidence from facts) where value <> ''", "facts")(inference.derived_entities)
q("w12_export_facts", f"select id, fingerprint, filename, fact_summary summary, category, severity_score severity, confidence, quality_score quality, round({W}, 6) weight, created_at from facts where {ALIVE} and category in ('financial', 'legal') and associated_date >= '2012' and {W} >= 0.3 order by weight desc, id limit 10000", "facts")(lambda f: export.facts(f, 0.3, 10_000, ["financial", "legal"], "2012"))
THREE = "cast(round(cast(cast({} as varchar) as decimal(38, 20)), 3) as decimal(18, 3))::varchar"
HEAVY = f"select *, round({W}, 6) weight from facts where {ALIVE} and {W} >= "
q("w13_fact_lines", f"""select id, concat_ws(',', id::varchar, '"' || replace(coalesce(filename, ''), '"', '""') || '"', '"' || replace(coalesce(fact_summary, ''), '"', '""') || '"', coalesce(category, ''), coalesce(severity_score::varchar, '0'), {THREE.format("coalesce(confidence, 0.0::double)")}, {THREE.format("weight")}) as line from ({HEAVY} 0.4) order by weight desc, id limit 1000""", "facts")(lambda f: export.fact_lines(f, 0.4, 1000))
q("w14_entity_lines", f"""with f as (select fingerprint, count(*) co from facts where {ALIVE} and confidence >= 0 group by 1), t as (select id, value, lower(entity_type) entity_type, co occurrences from entities join f using (fingerprint) where confidence >= 0 order by occurrences desc, id limit 50), c as (select *, round(occurrences / max(occurrences) over ()::double, 6) centrality from t) select id, concat_ws(',', id::varchar, '"' || replace(value, '"', '""') || '"', entity_type, occurrences::varchar, {THREE.format("centrality")}) as line from c""", "facts", "entities")(lambda f, e: export.entity_lines(f, e))
q("w15_timeline_json", f"select '{{' || concat_ws(',', '\"id\":' || id, '\"associated_date\":' || to_json(associated_date)::varchar, '\"fact_summary\":' || to_json(fact_summary)::varchar, '\"category\":' || to_json(category)::varchar, '\"severity_score\":' || severity_score) || '}}' as json from facts where {ALIVE} and associated_date is not null order by associated_date, id limit 10000", "facts")(lambda f: export.timeline(f))
q("stream_windowed_counts", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) n, round(avg(value), 6) mean from events group by 1, 2", "events")(lambda e: ingest.windowed_counts(e.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value"), "ts", "event_type", "value").withColumn("start", F.col("start").cast("timestamp_ntz")))


def derived_chains(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chains and links as facts imply them: a chain for each crime, linked by confidence."""
    named = facts.filter("identified_crime is not null")
    chain = F.xxhash64("identified_crime")
    links = named.select(F.col("id"), chain.alias("chain_id"), F.col("id").alias("intelligence_id"), F.coalesce("category", F.lit("none")).alias("relationship_type"), F.coalesce("confidence", F.lit(0.5)).alias("relationship_strength"), F.col("created_at").alias("linked_at"))
    heads = named.groupBy(F.col("identified_crime").alias("chain_name")).agg(F.max("created_at").alias("updated_at")).withColumn("id", F.xxhash64("chain_name")).withColumn("chain_type", F.lit("crime"))
    return heads, links


def chain_of(facts: DataFrame, name: str) -> int:
    """The id of a chain by its name: the 64-bit hash that derived_chains gives it."""
    return facts.sparkSession.range(1).select(F.xxhash64(F.lit(name))).first()[0]


q("a11_all_chains", "select chain_name, count(*) items, round(avg(coalesce(confidence, 0.5)), 6) mean_strength, max(created_at) updated_at from (select *, identified_crime chain_name from facts where identified_crime is not null) group by 1", "facts")(lambda f: chains.all_chains(*derived_chains(f), 1000).select("chain_name", "items", "mean_strength", "updated_at"))
q("a12_chain_statistics", "select count(*) items, round(avg(severity_score), 6) mean_severity, max(severity_score) top_severity, min(severity_score) least_severity, count(distinct category) categories, count(distinct coalesce(category, 'none')) relationships from facts where identified_crime = 'fraud'", "facts")(lambda f: chains.statistics(derived_chains(f)[1], f, chain_of(f, "fraud")).withColumns({"categories": F.size("categories").cast("long"), "relationships": F.size("relationships").cast("long")}))
q("c4_chain_items", "select id, fact_summary, filename, category, severity_score from facts where identified_crime = 'bribery'", "facts")(lambda f: chains.items(derived_chains(f)[1], f, chain_of(f, "bribery")).select("id", "fact_summary", "filename", "category", "severity_score"))
q("f6_chain_search", "select id, fact_summary from facts where identified_crime = 'theft' and (contains(lower(fact_summary), 'meeting') or contains(lower(filename), 'meeting') or contains(lower(category), 'meeting'))", "facts")(lambda f: chains.search(derived_chains(f)[1], f, chain_of(f, "theft"), "Meeting").select("id", "fact_summary"))
q("w10_chain_without", "select id from facts where identified_crime is not null and identified_crime <> 'theft'", "facts")(lambda f: chains.without_links(derived_chains(f)[1], chain_of(f, "theft")).select("id"))
q("n5_capped_weights", f"select id, round({W.replace('coalesce(severity_score, 0) / 5.0::double', 'least(coalesce(severity_score, 0) / 5.0::double, 1.0)')}, 6) weight from facts where {ALIVE}", "facts")(lambda f: f.filter(~F.coalesce("is_deleted", F.lit(False))).select("id", r6(weights.weight(True)).alias("weight")))
q("n7_source_weights", f"with r as (select fingerprint, avg(quality_score) reliability from text_cache group by 1), w as (select id, ({W.replace('coalesce(severity_score, 0) / 5.0::double', 'least(coalesce(severity_score, 0) / 5.0::double, 1.0)')}) * coalesce(reliability, 1.0) w from facts left join r using (fingerprint) where {ALIVE}) select id, round(w, 9) weight, case when w >= 0.6 then 'primary' else 'secondary' end as label from w", "facts", "text_cache")(lambda f, t: weights.custom_weighted(f, t.groupBy("fingerprint").agg(F.avg("quality_score").alias("reliability"))))
q("w4_status", "with e as (select fingerprint, max(created_at) made from text_cache group by 1) select id, coalesce(has_extracted_text, false) or e.made is not null has_text, coalesce(e.made, extracted_at) extracted_at, case when e.made is not null then 1.0::double else extraction_quality end quality from registry left join e using (fingerprint)", "registry", "text_cache")(lambda r, t: store.apply_status(r, t.select("fingerprint", F.lit("extracted").alias("status"), F.lit(False).alias("partial"), F.col("created_at").alias("at"))).select("id", F.col("has_extracted_text").alias("has_text"), "extracted_at", F.col("extraction_quality").alias("quality")))
q("w7_error_states", "select id error_id, retry_count, last_modified + to_minutes(retry_count * 2) next_attempt, retry_count < 3 and not coalesce(processed, false) as open from registry where retry_count > 0 and last_modified is not null", "registry")(lambda r: store.error_states(r.filter("retry_count > 0 and last_modified is not null").select(F.col("id").alias("error_id"), "retry_count", F.col("last_modified").alias("at"), F.col("processed").alias("resolved"))).select("error_id", "retry_count", "next_attempt", "open"))
q("w8_tag_removed", "select id, list_sort(list_filter(list_distinct(list_filter(list_transform(coalesce(tags, []), lambda t: trim(t)), lambda t: t <> '')), lambda t: t <> 'fraud')).array_to_string(',') as tags from facts", "facts")(lambda f: f.select("id", F.array_join(F.array_sort(queues.tag_removed(F.col("tags"), "fraud")), ",").alias("tags")))
q("s14_extraction_counts", "select extraction_id, strlen(text)::bigint bytes, len(list_filter(regexp_split_to_array(trim(text), '[ \\t\\n\\r\\f]+'), lambda x: x <> ''))::int words from document_extractions where text is not null", "document_extractions")(lambda d: d.filter("text is not null").select("extraction_id", F.octet_length("text").cast("long").alias("bytes"), F.size(F.array_remove(F.split("text", r"[ \t\n\r\f]+"), "")).alias("words")))
q("s17_page_counts", "select id, len(string_split(coalesce(extracted_text, ''), chr(12)))::int pages from text_cache", "text_cache")(lambda t: t.select("id", files.page_count(F.col("extracted_text")).alias("pages")))
q("j9_chains_left", "select identified_crime chain_name, count(*) items from facts where identified_crime is not null group by 1", "facts")(lambda f: chains.all_chains(*derived_chains(f), 1000).select("chain_name", "items"))
q("g11_resolve", "with a as (select id, value, entity_type, confidence from entities where value = 'Ostwick') select id, value, entity_type, 'place' alias_type, round(confidence, 6) alias_confidence from a", "entities")(lambda e: graph.resolve(e.filter("value = 'Ostwick'").select(F.col("id").alias("canonical_entity_id"), F.lit("the western port").alias("alias_value"), F.lit("place").alias("alias_type"), r6(F.col("confidence")).alias("confidence")), e, "the western port"))
q("a7_with_chains", f"select count(*) facts, round(avg(severity_score), 6) mean_severity, round(avg(confidence), 6) mean_confidence, round(avg(quality_score), 6) mean_quality, (select count(*) from entities) entities, (select count(distinct value) from entities) different_entities, (select count(distinct identified_crime) from facts) chains, (select count(identified_crime) from facts) links from facts where {ALIVE}", "facts", "entities")(lambda f, e: stats.overall_statistics(f, e, *derived_chains(f)))
q("a20_batch_outcome", "select count(*) filter (where coalesce(has_extracted_text, false)) successes, count(*) filter (where not coalesce(has_extracted_text, false)) errors from registry", "registry")(lambda r: stats.batch_outcome(r.select(F.when(F.coalesce("has_extracted_text", F.lit(False)), "ok").otherwise("error").alias("status"))))
q("t3_cluster_events", f"with recursive d as (select distinct {DAY} as day from facts where {ALIVE} and {DAY} is not null), r(day, start) as (select min(day), min(day) from d union all select x.day, case when x.day - r.start > 7 then x.day else r.start end from r, lateral (select min(day) as day from d where d.day > r.day) x where x.day is not null), f as (select id, {DAY} as day, severity_score from facts where {ALIVE}) select id, day, severity_score, start cluster_start from f join r using (day)", "facts")(lambda f: timeline.cluster_events(f, 7))
q("t5_backdating", f"with d as (select id, fingerprint, {DAY} - created_at::date days_ahead from facts where {ALIVE}) select id, fingerprint, days_ahead::int days_ahead, days_ahead > 30 flagged, round(least(days_ahead / 365.0::double, 1.0), 6) confidence from d where days_ahead > 0", "facts")(lambda f: timeline.backdating(f, 30))
q("c7_groups_by_file", None, "facts")(lambda f: dedup.groups(f, 0.85, ("fingerprint",)))
q("g9_modularity", None, "facts")(lambda f: graph.modularity(graph.people_pairs(f), graph.communities(graph.people_pairs(f))))
q("s2_type_map", "select map_from_entries(list((file_type, n) order by file_type)) files_by_type from (select file_type, count(*) n from registry where file_type is not null group by 1)", "registry")(stats.type_map)
q("c6_geographic", f"with {CASES}, l as (select 1 c, value, regexp_extract(value, '(-?[0-9]+\\.?[0-9]*)[,\\s]+(-?[0-9]+\\.?[0-9]*)', ['a', 'b']) m from e1 where lower(entity_type) = 'location' union all select 2, value, regexp_extract(value, '(-?[0-9]+\\.?[0-9]*)[,\\s]+(-?[0-9]+\\.?[0-9]*)', ['a', 'b']) from e2 where lower(entity_type) = 'location'), v as (select c, value, try_cast(m.a as double) lat, try_cast(m.b as double) lon from l), p as (select distinct c, value, lat, lon from v where lat between -90 and 90 and lon between -180 and 180), d as (select x.value place1, y.value place2, 2 * 6371.0088 * asin(least(sqrt(pow(sin(radians((x.lat - y.lat) / 2)), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians((x.lon - y.lon) / 2)), 2)), 1)) km from p x join p y on x.c = 1 and y.c = 2) select place1, place2, round(km, 3) km from d where km <= 500", "entities")(lambda e: compare.near_places(*halves(e), 500.0))
