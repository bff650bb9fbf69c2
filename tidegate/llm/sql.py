"""SQL of those queries that SQL can express."""

_KEYED = r"""keyed as (
  select rec_id,
    array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array(coalesce(full_name, ''), '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000},]+'), lambda w: regexp_replace(lower(w), '[^\p{L}\p{N}]+', '', 'g')), lambda w: w <> '')), ' ') as words,
    least(regexp_replace(lower(coalesce(email, '')), '[^\p{L}\p{N}]+', '', 'g'), regexp_replace(lower(coalesce(phone, '')), '[^\p{L}\p{N}]+', '', 'g')) as a,
    greatest(regexp_replace(lower(coalesce(email, '')), '[^\p{L}\p{N}]+', '', 'g'), regexp_replace(lower(coalesce(phone, '')), '[^\p{L}\p{N}]+', '', 'g')) as b
  from customer_export)"""

SQL: dict[str, str] = {
    "p5_found": f"with {_KEYED}, k as (select rec_id, min(rec_id) over (partition by words, a, b) as kept from keyed) select kept as kept_id, rec_id as copy_id from k where kept <> rec_id",
    "p5_groups": f"with {_KEYED} select min(rec_id) as kept_id, count(*) as n_copies from keyed group by words, a, b",
}
