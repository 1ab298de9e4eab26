"""Calls resolved to methods, and tables that reach through them, as joins.

modules: (module, kind, extended, implemented, table_name, mapper_entity, service_mapper); fields: (module, receiver,
declared); methods: (module, method, has_sql, has_calls); calls: (module, method, call); direct: (module, method,
edge_type, name).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions import javatext as J
from tracewell.operators.checkpoints import keep
from tracewell.operators.components import numbered, strong_components
from tracewell.operators.graph import ranked

_BASE = ("baseMapper", "getBaseMapper")


def implementations(modules: DataFrame) -> DataFrame:
    """(declared, n, only): how many classes implement a type, and one of them."""
    each = modules.where("kind = 'class'").select(F.explode("implemented").alias("declared"), "module")
    return each.groupBy("declared").agg(F.countDistinct("module").alias("n"), F.min("module").alias("only"))


def crud_tables(modules: DataFrame) -> DataFrame:
    """(module, table_name) of mappers bound to an entity with a table."""
    entity = modules.where("table_name is not null").select(F.col("module").alias("mapper_entity"), "table_name")
    return modules.where("mapper_entity is not null").select("module", "mapper_entity").join(entity, "mapper_entity").select("module", "table_name")


def candidates(calls: DataFrame, modules: DataFrame, fields: DataFrame) -> DataFrame:
    """(module, method, call, name, declared, implementors, base, candidate, rank): receivers' classes by priority."""
    own = modules.select("module", "service_mapper")
    split = calls.where(F.instr("call", ".") > 0).select("*", F.substring_index("call", ".", 1).alias("receiver"), F.substring_index("call", ".", -1).alias("name"))
    typed = split.join(fields, ["module", "receiver"], "left").join(own, "module", "left").withColumn("declared", J.type_name("declared"))
    typed = typed.join(implementations(modules).select("declared", F.col("n").alias("implementors"), "only"), "declared", "left")
    base = F.col("receiver").isin(*_BASE)
    named = F.when(F.col("declared").isNotNull(), F.when(F.col("implementors") == 1, F.concat(F.array("only"), J.implementation_names("declared"))).otherwise(J.implementation_names("declared")))
    mapper = F.when(base & F.col("declared").isNull(), F.array("service_mapper"))
    none = F.array().cast("array<string>")
    listed = F.array_distinct(F.array_compact(F.concat(F.coalesce(mapper, none), F.coalesce(named, none), F.array(J.bean_class("receiver")))))
    listed = F.when((base & F.col("service_mapper").isNull()) | (F.coalesce("implementors", F.lit(0)) > 1), none).otherwise(listed)
    return typed.select("module", "method", "call", "name", "declared", "implementors", base.alias("base"), F.posexplode_outer(listed).alias("rank", "candidate"))


def resolve_calls(calls: DataFrame, modules: DataFrame, fields: DataFrame, methods: DataFrame) -> DataFrame:
    """(module, method, call, target, target_method) of calls with a target; of candidates the first that can take it."""
    known = methods.select(F.col("module").alias("candidate"), F.col("method").alias("name"), (F.col("has_sql") | F.col("has_calls")).alias("does"))
    parsed = modules.select(F.col("module").alias("candidate"), F.col("service_mapper").alias("mapper"))
    bound = crud_tables(modules).select(F.col("module").alias("candidate"), F.lit(True).alias("bound"))
    declares = methods.select(F.col("module").alias("mapper"), F.col("method").alias("name"), F.lit(True).alias("mapper_has"))
    c = candidates(calls, modules, fields).join(parsed, "candidate").join(known, ["candidate", "name"], "left").join(bound, "candidate", "left").join(declares, ["mapper", "name"], "left")
    crud = F.col("name").isin(*J.CRUD_READS, *J.CRUD_WRITES)
    through = F.col("does").isNull() & ~(crud & F.col("bound").isNotNull()) & F.col("name").isin(*J.SERVICE_CRUD) & F.col("mapper_has").isNotNull()
    takes = F.when(F.col("does").isNull(), (crud & F.col("bound").isNotNull()) | through).otherwise(~((F.col("candidate") == F.col("declared")) & ~F.col("does")))
    target = F.when(through, F.col("mapper")).otherwise(F.col("candidate"))
    received = c.where(takes).groupBy("module", "method", "call", "name").agg(F.min_by(target, "rank").alias("target")).select("module", "method", "call", "target", F.col("name").alias("target_method"))

    # Local calls: a wrapper around the mapper's method of the same name, or the module's own method.
    local = calls.where(F.instr("call", ".") == 0)
    own = methods.select("module", F.col("method").alias("call"), "has_sql")
    kinds = calls.groupBy("module", F.col("method").alias("call")).agg(F.collect_set("call").alias("made"))
    mapper = modules.where("service_mapper is not null").select("module", "service_mapper")
    its = methods.select(F.col("module").alias("service_mapper"), F.col("method").alias("call"), F.lit(True).alias("its"))
    met = local.join(own, ["module", "call"], "left").join(kinds, ["module", "call"], "left").join(mapper, "module", "left").join(its, ["service_mapper", "call"], "left")
    wrapper = F.col("its").isNotNull() & ~F.coalesce("has_sql", F.lit(False)) & F.array_contains("made", "getBaseMapper") & (F.size(F.array_except("made", F.array(F.lit("getBaseMapper"), F.col("call")))) == 0)
    within = met.select("module", "method", "call", F.when(wrapper, F.col("service_mapper")).when(F.col("has_sql").isNotNull(), F.col("module")).alias("target"), F.col("call").alias("target_method")).where("target is not null")

    # A service's method without SQL whose calls are getBaseMapper and CRUD names alone sends these to the mapper.
    all_crud = F.array(*[F.lit(x) for x in (*J.CRUD_READS, *J.CRUD_WRITES)])
    bridge = calls.groupBy("module", "method").agg(F.collect_set("call").alias("made")).join(mapper, "module").join(methods.select("module", "method", "has_sql"), ["module", "method"])
    bridge = bridge.where(~F.col("has_sql") & ~F.array_contains(all_crud, F.col("method")) & F.array_contains("made", "getBaseMapper") & (F.size(F.array_except("made", F.concat(F.array(F.lit("getBaseMapper")), all_crud))) == 0))
    bridged = bridge.select("module", "method", F.explode(F.array_intersect("made", all_crud)).alias("call"), F.col("service_mapper").alias("target")).select("*", F.col("call").alias("target_method"))
    return received.unionByName(within.join(bridged.select("module", "method", "call"), ["module", "method", "call"], "left_anti")).unionByName(bridged).distinct()


def reduce_tables(resolved: DataFrame, direct: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, method, edge_type, name): tables that a method touches itself or through any chain of calls.

    A true fixpoint, also for methods that call each other: these are one component of the calls and share their tables, as
    bits, 64 of a word. Between components bits move against the calls, those that are new in a round only.
    """
    mapped = crud_tables(modules)
    crud = F.when(F.col("target_method").isin(*J.CRUD_READS), "READS").when(F.col("target_method").isin(*J.CRUD_WRITES), "WRITES")
    virtual = resolved.select(F.col("target").alias("module"), "target_method").distinct().join(mapped, "module").select("module", F.col("target_method").alias("method"), crud.alias("edge_type"), F.col("table_name").alias("name")).where("edge_type is not null")
    own = direct.select("module", "method").distinct()
    facts = keep(direct.select("module", "method", "edge_type", "name").unionByName(virtual.join(own, ["module", "method"], "left_anti")).distinct())
    method = lambda module, name: F.struct(F.col(module).alias("module"), F.col(name).alias("method"))
    made = keep(resolved.select(method("module", "method").alias("src"), method("target", "target_method").alias("dst")).unionByName(facts.select(method("module", "method").alias("src"), method("module", "method").alias("dst"))).distinct())
    vertices, edges = numbered(made)
    part = strong_components(edges)
    vertices = keep(vertices.join(part, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c")))
    of = lambda end, name: vertices.select(F.col("id").alias(end), F.col("c").alias(name))
    above = keep(edges.join(of("a", "caller"), "a").join(of("b", "callee"), "b").where("caller <> callee").select("caller", "callee").distinct())
    places = keep(ranked(facts.select("edge_type", "name").distinct(), "place", F.asc("edge_type"), F.asc("name")).withColumn("place", F.col("place") - 1))
    bit = F.expr("shiftleft(1L, cast(place % 64 as int))")
    held = facts.join(places, ["edge_type", "name"]).select(method("module", "method").alias("key"), F.floor(F.col("place") / 64).alias("word"), bit.alias("bit"))
    state = keep(held.join(vertices, "key").groupBy("c", "word").agg(F.bit_or("bit").alias("bits")))
    moved = state
    while True:
        offered = above.join(moved.withColumnRenamed("c", "callee"), "callee").groupBy(F.col("caller").alias("c"), "word").agg(F.bit_or("bits").alias("bits"))
        known = state.withColumnRenamed("bits", "known")
        new = offered.join(known, ["c", "word"], "left").select("c", "word", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0).cast("long")))).alias("bits"))
        moved = keep(new.where("bits <> 0"))
        if moved.isEmpty():
            break
        state = keep(state.unionByName(moved).groupBy("c", "word").agg(F.bit_or("bits").alias("bits")))
    each = state.select("c", "word", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k"), "bits").where(F.expr("shiftright(bits, k) & 1") == 1).select("c", (F.col("word") * 64 + F.col("k")).alias("place"))
    return keep(vertices.join(each, "c").join(places, "place").select("key.module", "key.method", "edge_type", "name"))


def rolled_up(facts: DataFrame, *keys: str) -> DataFrame:
    """(keys, reads, writes): sorted tables of both kinds, joined by commas."""
    names = lambda kind: F.array_join(F.array_sort(F.collect_set(F.when(F.col("edge_type") == kind, F.col("name")))), ",")
    return facts.groupBy(*keys).agg(names("READS").alias("reads"), names("WRITES").alias("writes"))


def unresolved(calls: DataFrame, resolved: DataFrame, modules: DataFrame, fields: DataFrame, methods: DataFrame) -> DataFrame:
    """(module, method, call, reason) of calls without a target, wrappers of results apart."""
    left = calls.where(~F.col("call").isin(*J.WRAPPER_CALLS)).join(resolved.select("module", "method", "call"), ["module", "method", "call"], "left_anti")
    local = left.where(F.instr("call", ".") == 0).select("module", "method", "call", F.lit("unresolved_local_method").alias("reason"))
    c = candidates(left, modules, fields).join(modules.select(F.col("module").alias("candidate"), F.lit(True).alias("parsed")), "candidate", "left")
    c = c.join(methods.select(F.col("module").alias("candidate"), F.col("method").alias("name"), F.lit(True).alias("has")), ["candidate", "name"], "left")
    known = c.groupBy("module", "method", "call", "name").agg(F.first("declared").alias("declared"), F.max("implementors").alias("implementors"), F.first("base").alias("base"), F.count("parsed").alias("parsed"), F.count("has").alias("has"))
    # Why a mapper call of a declared receiver has no table.
    kind = modules.select(F.col("module").alias("declared"), F.col("mapper_entity").alias("entity"), F.lit(True).alias("there"))
    table = modules.select(F.col("module").alias("entity"), F.col("table_name"))
    known = known.join(kind, "declared", "left").join(table, "entity", "left")
    crud = F.col("name").isin(*J.CRUD_READS, *J.CRUD_WRITES) & F.col("declared").isNotNull()
    missing = F.when(F.col("there").isNull(), "crud_method_without_table_binding").when(F.col("entity").isNull(), "mapper_without_basemapper_entity").when(F.col("table_name").isNull(), "entity_without_table_name")
    plain = (
        F.when(F.col("declared").isNull(), F.when(F.col("base"), "unresolved_receiver_target").otherwise("unresolved_receiver_type"))
        .when(F.coalesce("implementors", F.lit(0)) > 1, "multiple_impl_candidates")
        .when(F.col("parsed") == 0, "unresolved_receiver_target")
        .when(F.col("has") == 0, "unresolved_target_method")
        .otherwise("unresolved_target")
    )
    return local.unionByName(known.select("module", "method", "call", F.coalesce(F.when(crud, missing), plain).alias("reason")))


def endpoint_diagnostics(endpoints: DataFrame, calls: DataFrame, resolved: DataFrame, failed: DataFrame, facts: DataFrame) -> DataFrame:
    """(endpoint, resolved_calls, unresolved_calls, reasons, reads, writes): direct calls of an endpoint's method, and tables."""
    direct = calls.where(~F.col("call").isin(*J.WRAPPER_CALLS)).join(resolved.select("module", "method", "call", F.lit(1).alias("ok")).distinct(), ["module", "method", "call"], "left").join(failed, ["module", "method", "call"], "left")
    told = F.when(F.col("ok").isNull(), F.concat_ws(":", "call", "reason"))
    counts = direct.groupBy("module", "method").agg(F.count("ok").alias("resolved_calls"), F.count_if(F.col("ok").isNull()).alias("unresolved_calls"), F.array_join(F.array_sort(F.collect_set(told)), ",").alias("reasons"))
    zero = F.lit(0).cast("long")
    joined = endpoints.join(counts, ["module", "method"], "left").join(rolled_up(facts, "module", "method"), ["module", "method"], "left")
    return joined.select("endpoint", F.coalesce("resolved_calls", zero).alias("resolved_calls"), F.coalesce("unresolved_calls", zero).alias("unresolved_calls"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("reasons", "reads", "writes")])
