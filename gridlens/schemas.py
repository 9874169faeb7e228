"""Record schemas, always given to the readers."""

from __future__ import annotations

from pyspark.sql import types as T

_F = T.ArrayType(T.FloatType())
_I = T.ArrayType(T.IntegerType())
_S = T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: Names of the array fields by what they are indexed with.
LINE_FIELDS = ("rho", "p_or", "q_or", "p_ex", "q_ex", "v_or", "v_ex")
BUS_FIELDS = ("load_p", "load_q", "gen_p", "gen_q", "topo_vect")

#: Field names of the records.
OBSERVATION = _struct(
    **{k: _F for k in LINE_FIELDS},
    line_status=T.ArrayType(T.BooleanType()),
    **{k: _F for k in BUS_FIELDS},
    label=_S,
    label_int=T.IntegerType(),
    fault_loc=T.IntegerType(),
    timestep=T.IntegerType(),
    chronic_id=T.IntegerType(),
    reward=T.DoubleType(),
)

#: Field names of the metadata.
METADATA = _struct(
    env_name=_S,
    smoke_run=T.BooleanType(),
    n_sub=T.IntegerType(),
    n_line=T.IntegerType(),
    n_load=T.IntegerType(),
    n_gen=T.IntegerType(),
    topology=_struct(line_or_bus=_I, line_ex_bus=_I, load_to_sub=_I, gen_to_sub=_I),
    n_classes=T.IntegerType(),
    label_map=T.MapType(_S, T.IntegerType()),
    rho_clip=T.DoubleType(),
    total_records=T.LongType(),
    label_counts=T.MapType(_S, T.LongType()),
    label_pct=T.MapType(_S, T.DoubleType()),
    throughput_steps_per_sec=T.LongType(),
    total_time_sec=T.DoubleType(),
    node_feature_dim=T.IntegerType(),
    edge_feature_dim=T.IntegerType(),
)

#: Field names of rules and verdicts.
RULE_FIELDS = ("rule_id", "source", "entity", "condition", "action", "severity", "explanation")
RULE = _struct(**{k: _S for k in RULE_FIELDS})
CANDIDATE = _struct(rule=RULE, chunk=_S)
VERDICT = _struct(rule_id=_S, verdict=_S, corrected_fields=T.MapType(_S, _S), reason=_S)
FLAGGED = _struct(rule=RULE, verdict=VERDICT)

#: The label classes in the order of their ids.
LABELS = ("normal", "overload", "line_trip", "cascade", "maintenance")
