"""Schemas of the driver tables, as source, and of the tables that queries map them to."""

SOURCE = """
name: star
default_range: string
classes:
  orders: {slots: [o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority]}
  lineitem: {slots: [l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate]}
  customer: {slots: [c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment]}
  events: {slots: [event_id, user_id, event_type, value, props]}
  embeddings: {slots: [vec_id, embedding, label]}
slots:
  o_orderkey: {range: integer, identifier: true, required: true}
  o_custkey: {range: integer}
  o_orderstatus: {range: statusSet}
  o_totalprice: {range: float}
  o_orderdate: {range: datetime}
  o_orderpriority: {range: prioritySet}
  l_orderkey: {range: integer}
  l_linenumber: {range: integer}
  l_quantity: {range: float}
  l_extendedprice: {range: float}
  l_discount: {range: float}
  l_tax: {range: float}
  l_returnflag: {range: flagSet}
  l_linestatus: {range: lineSet}
  l_shipdate: {range: datetime}
  c_custkey: {range: integer}
  c_nationkey: {range: integer}
  c_acctbal: {range: float}
  c_mktsegment: {range: segmentSet}
  event_id: {range: integer}
  user_id: {range: integer}
  event_type: {range: eventSet}
  value: {range: float}
  vec_id: {range: integer}
  embedding: {range: float, multivalued: true}
  label: {range: integer}
enums:
  statusSet: {permissible_values: {F: {}, O: {}, P: {}}}
  prioritySet: {permissible_values: {1-URGENT: {}, 2-HIGH: {}, 3-MEDIUM: {}, 4-NOT SPECIFIED: {}, 5-LOW: {}}}
  flagSet: {permissible_values: {A: {}, N: {}, R: {}}}
  lineSet: {permissible_values: {F: {}, O: {}}}
  segmentSet: {permissible_values: {AUTOMOBILE: {}, BUILDING: {}, FURNITURE: {}, HOUSEHOLD: {}, MACHINERY: {}}}
  eventSet: {permissible_values: {click: {}, error: {}, purchase: {}, signup: {}, view: {}}}
"""

TARGET = """
name: long
default_range: string
classes:
  sales: {slots: [saleID, buyerID, state, amount, day, urgency, origin, big]}
  measures: {slots: [saleID, line, measure, value, unit, flag, purpose]}
  people: {slots: [personID, segment, balance, note]}
  vectors: {slots: [vectorID, first]}
slots:
  saleID: {range: integer, identifier: true, required: true}
  buyerID: {range: integer}
  state: {range: stateSet, required: true}
  amount: {range: float}
  day: {range: date}
  urgency: {range: urgencySet}
  origin: {range: string}
  big: {range: boolean}
  line: {range: integer}
  measure: {range: measureSet}
  value: {range: float}
  unit: {range: unitSet}
  flag: {range: returnSet}
  purpose: {any_of: [{range: string}, {range: unitSet}]}
  personID: {range: integer}
  segment: {range: marketSet}
  balance: {range: float}
  vectorID: {range: integer}
  first: {range: float}
enums:
  stateSet: {permissible_values: {closed: {}, open: {}, partial: {}}}
  urgencySet: {permissible_values: {high: {}, normal: {}, low: {}}}
  measureSet: {permissible_values: {quantity: {}, price: {}, discount: {}, tax: {}}}
  unitSet: {permissible_values: {pieces: {}, currency: {}, share: {}}}
  returnSet: {permissible_values: {accepted: {}, none: {}, returned: {}}}
  marketSet: {permissible_values: {cars: {}, homes: {}}}
"""
