"""The derivations of ``bridge`` as SQL, for checking results with another engine."""

LR = r"""
with p as (select greatest(4000, cast(ceil(count(*) / 10000.0) as bigint)) as r from events),
ev as (select e.*, p.r, regexp_extract(props, '[0-9]+') as k, chr(13) || chr(10) as crlf
       from events e, p),
lr as (
  select event_id // r as src, 'events-' || (event_id // r) as source, event_id % r as idx,
    ts as "timestamp",
    case when user_id % 50 = 0 then null
         when event_type = 'view' then 'Trace' when event_type = 'click' then 'Debug'
         when event_type = 'signup' then 'Info' when event_type = 'purchase' then 'Warn'
         when event_type = 'error' and value >= 150 then 'Fatal'
         when event_type = 'error' then 'Error' end as level,
    'Shop.' || case when event_type = 'purchase' then 'Billing.' else 'Web.' end
      || event_type as logger,
    cast(user_id % 8 as varchar) as thread,
    'user ' || user_id || ' ' || event_type || ' k=' || k
      || case when event_id % 10 = 0 then crlf || 'more; for "' || user_id || '" and others'
         else '' end as message,
    case when event_type = 'error' then
      'System.InvalidOperationException: bad k' || crlf
      || '   at Shop.Web.Cart.Add(Int32 k) in c:\src\Cart.cs:line ' || k
      || case when cast(k as int) % 2 = 1 then crlf || '   at Shop.Web.Cart.Run()' else '' end
      || case when cast(k as int) % 5 = 0 then crlf || 'end of trace' else '' end
    end as exception,
    cast(user_id as varchar) as "user", k
  from ev)
"""

CSV_TEXT = LR + r""",
csv0 as (select *, replace(message, '"', '""') as csv_message,
    coalesce(exception, '') as csv_exception,
    strftime("timestamp", '%Y-%m-%d %H:%M:%S.%f') || ';' || coalesce(level, 'Notice') || ';'
      || logger || ';"' || replace(message, '"', '""') || '";"' || coalesce(exception, '')
      || '";' || "user" || ';' || k || case when idx % 97 = 96 then ';extra' else '' end as raw
  from lr),
csv as (select *, cast(44 + coalesce(sum(strlen(raw) + 2) over (partition by src order by idx
      rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset",
    cast(strlen(raw) + 2 as bigint) as length from csv0)
"""

EVENT_TEXT = LR + r""",
esc as (select *,
    replace(replace(replace(message, '"', '&quot;'), chr(13), '&#13;'), chr(10), '&#10;') as m,
    replace(replace(exception, chr(13), '&#13;'), chr(10), '&#10;') as e from lr),
xml as (select *,
    '<log4j:event logger="' || logger || '" level="' || upper(coalesce(level, 'Notice'))
      || '" timestamp="' || (epoch_us("timestamp") // 1000) || '" thread="' || thread
      || '"><log4j:message>' || m || case when idx % 101 = 0 then '' else '</log4j:message>' end
      || '<log4j:properties>'
      || coalesce('<log4j:data name="exception" value="' || e || '" />', '')
      || '<log4j:data name="user" value="' || "user"
      || '" /></log4j:properties></log4j:event>' as raw,
    timestamp '1970-01-01' + to_seconds(cast(round_even((epoch_us("timestamp") // 1000) / 1000.0, 0)
      as bigint)) as event_time from esc)
"""

PLAIN_TEXT = LR + r""",
parts as (select src, idx, unnest(string_split(message, chr(13) || chr(10))) as line,
    generate_subscripts(string_split(message, chr(13) || chr(10)), 1) as pos from lr
  union all select src, idx, '' as line, 9 as pos from lr where idx % 7 = 0),
placed as (select src, idx, pos, line, cast(coalesce(sum(strlen(line) + 2) over (
      partition by src order by idx, pos rows between unbounded preceding and 1 preceding), 0)
      as bigint) as "offset",
    cast(strlen(line) + 2 as bigint) as length from parts),
plain as (select src, row_number() over (partition by src order by idx, pos) - 1 as idx,
    "offset", length, line from placed where line <> '')
"""

RULES_TEXT = LR + r""",
stamped as (select *, strftime("timestamp", '%d.%m.%YT%H:%M:%S') || ' '
      || upper(coalesce(level, 'Notice')) || ' ' || message as raw from lr),
ruled as (select *, cast(coalesce(sum(strlen(raw) + 2) over (partition by src order by idx
      rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset" from stamped)
"""
