-- Input views over the given tables, in SQL that Spark and DuckDB both accept.
-- One view per section; a section starts with a line '-- view: <name>'.

-- view: zone_seed
select c_custkey as n_nationkey, c_name as n_name from customer

-- view: fx_domain
select concat('d', cast(n_nationkey as string), '.example.com') as domain,
 case when n_nationkey % 7 = 3 then 1 else 0 end as backupmx, case when n_nationkey % 5 = 4 then 0 else 1 end as active,
 40 + n_nationkey as mailboxes, 5 + n_nationkey % 4 as aliases, cast(64 as bigint) as maxquota from nation
union all select 'ALL', 0, 0, 0, 0, cast(0 as bigint)

-- view: fx_mailbox
select concat('u', cast(c_custkey as string), '@d', cast(c_nationkey as string), '.example.com') as username,
 concat('u', cast(c_custkey as string)) as local_part, concat('d', cast(c_nationkey as string), '.example.com') as domain,
 concat('d', cast(c_nationkey as string), '.example.com/u', cast(c_custkey as string), '/') as maildir,
 case when c_custkey % 11 = 0 then cast(0 as bigint) else cast((1 + c_custkey % 5) * 16384 as bigint) end as quota,
 case when c_custkey % 13 = 0 then 0 else 1 end as active,
 case when c_custkey % 4 <> 0 then timestamp '2000-01-01 00:00:00' when c_custkey % 8 = 0 then timestamp '2023-06-01 00:00:00' else timestamp '2030-01-01 00:00:00' end as password_expiry,
 case when c_custkey % 9 = 0 then concat('t', cast(c_custkey as string)) else '' end as token,
 case when c_custkey % 18 = 0 then timestamp '2024-02-01 01:00:00' else timestamp '2000-01-01 00:00:00' end as token_validity
from customer

-- view: fx_alias_domain
select concat('r', cast(n_nationkey as string), '.example.net') as alias_domain, concat('d', cast(n_nationkey as string), '.example.com') as target_domain,
 case when n_nationkey % 9 = 0 then 0 else 1 end as active from nation where n_nationkey % 3 = 0

-- view: fx_alias
select concat('s', cast(s.s_suppkey as string), '@d', cast(s.s_nationkey as string), '.example.com') as address,
 case when s.s_suppkey % 5 = 3 then concat('s', cast(p.s_suppkey as string), '@d', cast(p.s_nationkey as string), '.example.com,ext', cast(s.s_suppkey as string), '@elsewhere.org')
 else concat('u', cast(a.c_custkey as string), '@d', cast(a.c_nationkey as string), '.example.com,u', cast(b.c_custkey as string), '@d', cast(b.c_nationkey as string), '.example.com') end as goto_list,
 concat('d', cast(s.s_nationkey as string), '.example.com') as domain, case when s.s_suppkey % 10 = 9 then 0 else 1 end as active
from supplier s join customer a on a.c_custkey = s.s_suppkey join customer b on b.c_custkey = s.s_suppkey + 1
 left join supplier p on p.s_suppkey = s.s_suppkey - 1
union all select concat('@d', cast(n_nationkey as string), '.example.com'), concat('postmaster@d', cast(n_nationkey as string), '.example.com'),
 concat('d', cast(n_nationkey as string), '.example.com'), 1 from nation where n_nationkey % 4 = 0

-- view: fx_alias_loop
select concat('loop', cast(s_suppkey as string), '@l.example.com') as address,
 concat('loop', cast(s_suppkey - s_suppkey % 3 + (s_suppkey + 1) % 3 as string), '@l.example.com,loop', cast(s_suppkey % 5 as string), '@l.example.com,end', cast(s_suppkey % 7 as string), '@l.example.com') as goto_list
from supplier

-- view: fx_rcpt
select o.o_orderkey as rcpt_id, case o.o_orderkey % 6
 when 0 then concat('u', cast(c.c_custkey as string), '@d', cast(c.c_nationkey as string), '.example.com')
 when 1 then concat('S', cast(s.s_suppkey as string), case when o.o_orderkey % 12 = 7 then '@R' else '@D' end, cast(s.s_nationkey as string), case when o.o_orderkey % 12 = 7 then '.Example.net' else '.Example.com' end)
 when 2 then concat('nobody', cast(o.o_orderkey as string), '@d', cast(o.o_orderkey % 25 as string), '.example.com')
 when 3 then concat('u', cast(c.c_custkey as string), '@r', cast(c.c_nationkey as string), '.example.net')
 when 4 then concat('u', cast(c.c_custkey as string), '+tag', cast(o.o_orderkey % 7 as string), '@d', cast(c.c_nationkey as string), '.example.com')
 else concat('x', cast(o.o_orderkey as string), '@elsewhere.org') end as rcpt,
 concat('u', cast((c.c_custkey + o.o_orderkey % 2) as string), '@d', cast(c.c_nationkey as string), '.example.com') as sasl_login, o.o_orderdate as ts
from orders o join customer c on c.c_custkey = o.o_custkey join supplier s on s.s_suppkey = o.o_orderkey % 10

-- view: fx_log_a
select o_orderkey * 2 + 1 as id, concat('k', cast(o_orderkey as string)) as natural_key, o_orderpriority as data, o_orderdate as created
from orders where o_orderkey % 10 <> 7

-- view: fx_log_b
select o_orderkey * 2 + 1 as id, concat('k', cast(o_orderkey as string)) as natural_key, case when o_orderkey % 50 = 0 then 'DIVERGED' else o_orderpriority end as data,
 case when o_orderkey % 100 = 0 then o_orderdate + interval '1' day else o_orderdate end as created
from orders where o_orderkey % 10 <> 3

-- view: fx_id
select o_orderkey * 2 + case when o_custkey % 2 = 1 then 1 else 0 end + case when o_orderkey % 200 = 0 then 1 else 0 end as id,
 case when o_custkey % 2 = 1 then 'A' else 'B' end as node, o_orderdate as ts from orders

-- view: fx_msg
select d.doc_id as guid, d.node, concat('u', cast(c.c_custkey as string), '@d', cast(c.c_nationkey as string), '.example.com') as username,
 case d.doc_id % 8 when 0 then 'Junk' when 1 then 'Trash' when 2 then 'Sent Items' when 3 then 'Sent' else 'INBOX' end as folder,
 d.n_chars as vsize, d.doc_id * 3 + case when d.node = 'B' and d.doc_id % 4 = 0 then 1 else 0 end as modseq,
 case when d.node = 'A' then (case when d.doc_id % 3 = 0 then 'S' else '' end) else (case when d.doc_id % 4 = 0 then 'SR' when d.doc_id % 3 = 0 then 'S' else '' end) end as flags,
 case when d.node = 'B' and d.doc_id % 20 = 3 then 1 else 0 end as expunged,
 timestamp '2024-01-31 00:00:00' - interval '1' day * cast(d.doc_id % 90 as int) as saved_at
from (select doc_id, n_chars, 'A' as node from documents union all select doc_id, n_chars, 'B' as node from documents) d join customer c on c.c_custkey = d.doc_id % 50
where (d.node = 'A' and d.doc_id % 10 <> 7) or (d.node = 'B' and d.doc_id % 10 <> 6)

-- view: fx_move
select doc_id as guid, doc_id % 50 as user_no, case when doc_id % 3 = 0 then 'Junk' else 'INBOX' end as from_folder,
 case when doc_id % 3 = 0 then (case when doc_id % 2 = 0 then 'INBOX' else 'Trash' end) when doc_id % 5 = 0 then 'Junk' else 'Archive' end as to_folder from documents

-- view: fx_header
select doc_id as guid, doc_id % 2 as submitted,
 concat('Received: from [10.0.0.', cast(doc_id % 200 as string), '] by sg1 with ESMTPSA; id ', cast(doc_id as string), chr(10),
  'Received: from mx.elsewhere.org by sg1 with ESMTP', chr(10), 'X-Mailer: Client ', cast(doc_id % 4 as string), chr(10),
  'Bcc: hidden@d1.example.com', chr(10), 'Message-ID: <m', cast(doc_id as string), '@laptop.local>', chr(10),
  case when doc_id % 9 = 0 then concat('X-Spam: Yes', chr(10)) else '' end, 'X-Spam-Level: ', repeat('*', cast(doc_id % 13 as int)), chr(10),
  case when doc_id % 11 = 0 then concat('Auto-Submitted: auto-generated', chr(10)) else '' end, 'Subject: s') as raw from documents

-- view: fx_auth
select event_id, ts, user_id, concat('203.0.113.', cast(user_id % 40 as string)) as ip,
 case when event_type = 'error' then 'fail' when event_type = 'signup' then 'ok' else 'other' end as outcome,
 case user_id % 3 when 0 then 'dovecot' when 1 then 'webmail' else 'admin' end as jail, case when event_id % 2 = 0 then 'A' else 'B' end as node from events

-- view: fx_access
select event_id, ts, concat('203.0.113.', cast(user_id % 40 as string), ' - - [T] "', case when event_type in ('error', 'signup') then 'POST /login.php' else 'GET /index.php' end,
 ' HTTP/2.0" ', case when event_type = 'error' then '200' when event_type = 'signup' then '302' else '200' end, ' ', cast(event_id % 5000 as string),
 ' "-" "agent" rt=0.', cast(100 + event_id % 900 as string), ' node=', case when event_id % 2 = 0 then 'sg1' else 'us1' end) as line from events

-- view: fx_sample
select event_id as sample_id, ts, case when event_id % 2 = 0 then 'A' else 'B' end as node, cast(floor(value * 2) as bigint) as lag_s,
 cast(floor(value * 3) as bigint) as queued, cast(event_id % 100 as bigint) as disk_pct,
 case when event_type = 'error' and event_id % 97 = 0 then 1062 else 0 end as errno from events

-- view: fx_cert
select concat('h', cast(p_partkey % 200 as string), '.example.com') as lineage, p_partkey as serial, p_partkey as seq, p_size * 3 - 10 as days_left,
 concat('h', cast(p_partkey % 200 as string), '.example.com, www', cast(p_partkey % 7 as string), '.example.com') as sans,
 md5(cast(p_partkey as string)) as cert_hash, md5(cast(case when p_partkey % 50 = 0 then -1 else p_partkey end as string)) as key_hash from part

-- view: fx_dns
select zone, case when i in (0, 1, 6, 7) then '@' when i in (2, 3, 9) then 'mail' when i in (4, 5) then 'admin' when i = 8 then '_dmarc' when i = 10 then '_pop3._tcp' when i in (11, 12) then 'webmail' when i in (13, 14) then 'autoconfig' else 'autodiscover' end as name,
 case when i < 2 then 'MX' when i in (6, 7, 8) then 'TXT' when i = 9 then 'AAAA' when i = 10 then 'SRV' else 'A' end as type, case when i < 2 then 10 else 0 end as prio,
 case i when 0 then 'sg1.example.com.' when 1 then (case when n % 6 = 0 then '203.0.113.10' else 'us1.example.com.' end)
  when 6 then (case when n % 9 = 0 then 'v=spf1 ip4:203.0.113.10 ~all' else 'v=spf1 ip4:203.0.113.10 ip4:198.51.100.20 -all' end) when 7 then 'v=spf1 include:other.example -all'
  when 8 then concat('v=DMARC1; p=', case n % 3 when 0 then 'none' when 1 then 'quarantine' else 'reject' end, '; adkim=r; aspf=r') when 9 then '2001:db8::1' when 10 then (case when n % 4 = 1 then 'mail.example.com.' else '.' end)
  else (case when i in (2, 4, 11, 13, 15) then '203.0.113.10' else '198.51.100.20' end) end as target,
 case when i = 2 then (case when n % 4 = 0 then 3600 else 300 end) when i = 16 then (case when n % 12 = 5 then 900 else 300 end) when i in (3, 4, 5, 9, 11, 12, 13, 14, 15) then 300 else 3600 end as ttl
from (select n_nationkey as n, concat('d', cast(n_nationkey as string), '.example.com') as zone, explode(array(0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16)) as i from zone_seed) r
where case i when 1 then n % 5 <> 0 when 3 then n % 7 <> 0 when 5 then n % 8 = 0 when 7 then n % 10 = 0 when 8 then n % 11 <> 0 when 9 then n % 5 = 1 when 12 then n % 6 <> 5 when 13 then n % 9 <> 2 else true end

-- view: fx_ptr
select concat('10.', cast(cast(floor(n_nationkey / 65536) as int) % 256 as string), '.', cast(cast(floor(n_nationkey / 256) as int) % 256 as string), '.', cast(n_nationkey % 256 as string)) as ip,
 concat('n', cast(n_nationkey as string), '.example.com') as expected,
 case when n_nationkey % 6 = 5 then cast(null as string) when n_nationkey % 7 = 1 then 'other.example.com' else concat('n', cast(n_nationkey as string), '.example.com') end as ptr
from zone_seed

-- view: fx_forward
select concat('n', cast(n_nationkey as string), '.example.com') as name,
 case when n_nationkey % 8 = 2 then '192.0.2.200' else concat('10.', cast(cast(floor(n_nationkey / 65536) as int) % 256 as string), '.', cast(cast(floor(n_nationkey / 256) as int) % 256 as string), '.', cast(n_nationkey % 256 as string)) end as address
from zone_seed where n_nationkey % 10 <> 9

-- view: fx_dkim
select concat('d', cast(n_nationkey as string), '.example.com') as zone, 'sg' as selector, repeat(md5(n_name), 12) as local_key,
 case when n_nationkey % 7 = 0 then cast(null as string) when n_nationkey % 6 = 0 then substr(repeat(md5(n_name), 12), 1, 255)
 when n_nationkey % 8 = 0 then repeat(md5('x'), 12) else repeat(md5(n_name), 12) end as published from zone_seed

-- view: fx_report
select concat('d', cast(user_id % 25 as string), '.example.com') as domain, case when event_id % 2 = 0 or user_id % 25 = 3 then 'sg' else 'us' end as selector,
 case when event_type = 'error' and user_id % 5 = 0 then 0 else 1 end as pass, ts, user_id from events

-- view: fx_dnsbl
select concat('203.0.113.', cast(user_id % 40 as string)) as ip, case event_type when 'error' then 'zen' when 'click' then 'spamcop' when 'view' then 'barracuda' else 'dnswl2' end as list_name
from events

-- view: fx_vacation
select concat('u', cast(c_custkey as string), '@d', cast(c_nationkey as string), '.example.com') as email, case when c_custkey % 15 = 0 then 0 else 1 end as active,
 timestamp '2024-01-05 00:00:00' as activefrom, case when c_custkey % 2 = 0 then timestamp '2024-01-20 00:00:00' else timestamp '2100-01-01 00:00:00' end as activeuntil,
 cast(c_custkey % 4 * 86400 as int) as interval_time from customer where c_custkey % 3 = 0

-- view: fx_tls
select concat('d', cast(n_nationkey as string), '.example.com') as domain, case n_nationkey % 3 when 0 then 'encrypt' when 1 then 'may' else 'secure' end as policy,
 case when n_nationkey % 3 = 2 then 'match=mail.example.com' else '' end as params, case when n_nationkey % 5 = 0 then 0 else 1 end as active from nation

-- view: fx_grant
select concat('admin', cast(n_nationkey % 6 as string)) as username, case when n_nationkey % 6 = 0 then 'ALL' else concat('d', cast(n_nationkey as string), '.example.com') end as domain, 1 as active from nation

-- view: fx_audit
select o_orderkey as id, o_orderdate as ts, concat('admin', cast(o_custkey % 6 as string)) as username, concat('d', cast(o_custkey % 25 as string), '.example.com') as domain,
 case o_orderstatus when 'O' then 'create_mailbox' when 'F' then 'delete_mailbox' else 'edit_alias' end as action from orders

-- view: fx_delivery
select o_orderkey as queue_id, o_orderdate as queued_at, case when o_orderkey % 9 = 0 then cast(null as int) else cast(o_orderkey % 80 as int) end as delivered_after_h from orders

-- view: fx_host
select p_partkey as host_no, p_size * 200 as ram_mb, p_size as disk_gb, case when p_partkey % 10 = 0 then '22.04' else '24.04' end as os_version,
 case p_partkey % 4 when 0 then 3306 when 1 then 12345 when 2 then 25 else 993 end as port, case when p_partkey % 7 = 0 then 1 else 0 end as reachable_public from part

-- view: fx_access_line
select event_id, concat('203.0.113.', cast(user_id % 40 as string), ' - - [', concat(lpad(cast(day(ts) as string), 2, '0'), '/', substr('JanFebMarAprMayJunJulAugSepOctNovDec', month(ts) * 3 - 2, 3), '/', cast(year(ts) as string), ':', substr(cast(ts as string), 12, 8), ' +0000'), '] "',
 case when event_type in ('error', 'signup') then (case when event_id % 5 = 0 then 'POST /users/password-recover.php?x=1' else 'POST /login.php' end) else 'GET /index.php' end,
 ' HTTP/2.0" ', case when event_type = 'error' then '200' when event_type = 'signup' then '302' else '200' end, ' ', cast(event_id % 5000 as string),
 ' "-" "agent" rt=0.', cast(100 + event_id % 900 as string), ' node=', case when event_id % 2 = 0 then 'sg1' else 'us1' end) as line from events

-- view: fx_webmail_line
select event_id, concat('[', concat(lpad(cast(day(ts) as string), 2, '0'), '-', substr('JanFebMarAprMayJunJulAugSepOctNovDec', month(ts) * 3 - 2, 3), '-', cast(year(ts) as string), ' ', substr(cast(ts as string), 12, 8), ' +0000'), ']: ', case when event_id % 4 = 0 then '' else concat('<s', cast(event_id as string), '> ') end,
 case when event_type = 'error' and event_id % 3 = 0 then concat('IMAP Error: Login failed for u', cast(user_id as string), '@d1.example.com against 127.0.0.1 from 203.0.113.', cast(user_id % 40 as string), '. AUTHENTICATE PLAIN: failed')
  when event_type = 'error' and event_id % 3 = 1 then concat('Failed login for u', cast(user_id as string), '@d1.example.com from 203.0.113.', cast(user_id % 40 as string), ' in session a', cast(event_id as string), ' (error: 0)')
  when event_type = 'error' then concat('Error: Login failed for u', cast(user_id as string), '@d1.example.com from 203.0.113.', cast(user_id % 40 as string))
  when event_type = 'signup' then concat('Successful login for u', cast(user_id as string), '@d1.example.com from 203.0.113.', cast(user_id % 40 as string), ' in session a', cast(event_id as string))
  else 'PHP Notice: nothing to see' end) as line from events

-- view: fx_imap_line
select event_id, concat(substr(cast(ts as string), 1, 19), ' ', case when event_type = 'error' then
  (case event_id % 4 when 0 then concat('imap-login: Info: Disconnected (auth failed, 1 attempts in 2 secs): user=<u', cast(user_id as string), '@d1.example.com>, method=PLAIN, rip=203.0.113.', cast(user_id % 40 as string), ', lip=10.0.0.1, session=<x', cast(event_id as string), '>')
   when 1 then concat('managesieve-login: Warning: Aborted login (no auth attempts): user=<>, rip=203.0.113.', cast(user_id % 40 as string), ', lip=10.0.0.1, session=<x', cast(event_id as string), '>')
   when 2 then concat('doveadm: Error: Authentication failed for peer rip=203.0.113.', cast(user_id % 40 as string))
   else concat('imap-login: Info: Login aborted: user=<>, rip=203.0.113.', cast(user_id % 40 as string), ', lip=10.0.0.1, session=<x', cast(event_id as string), '>') end)
  else concat('imap-login: Info: Login: user=<u', cast(user_id as string), '@d1.example.com>, method=PLAIN, rip=203.0.113.', cast(user_id % 40 as string), ', lip=10.0.0.1, session=<x', cast(event_id as string), '>') end) as line from events

-- view: fx_mail_event_line
select doc_id, concat('imap(u', cast(doc_id % 50 as string), '@d1.example.com)<77><s', cast(doc_id as string), '> sg1: ',
 case doc_id % 9 when 0 then 'delete' when 1 then 'undelete' when 2 then 'expunge' when 3 then 'copy' when 4 then 'mailbox_delete' when 5 then 'mailbox_rename' when 6 then 'flag_change' when 7 then 'save' else 'expunge' end,
 ': uid=', cast(doc_id as string), ', box=', case when doc_id % 4 = 0 then 'Sent Items' else 'INBOX' end, ', msgid=<m', cast(doc_id as string), '@x.org>, size=', cast(n_chars as string),
 ', from=a@b.org, subject=Re: hello, you, flags=(', case when doc_id % 2 = 0 then 'Seen Answered' else '' end, ')') as line from documents

-- view: fx_status_text
select event_id as sample_id, ts, case when event_id % 2 = 0 then 'A' else 'B' end as node,
 concat('*** 1. row ***', chr(10), '      Slave_IO_Running: ', case when event_id % 41 = 0 then 'No' else 'Yes' end, chr(10), '     Slave_SQL_Running: ', case when event_type = 'error' and event_id % 97 = 0 then 'No' else 'Yes' end, chr(10),
 ' Seconds_Behind_Master: ', case when event_id % 53 = 0 then 'NULL' else cast(cast(floor(value * 2) as bigint) as string) end, chr(10), '            Last_Errno: ', case when event_type = 'error' and event_id % 97 = 0 then '1062' when event_id % 101 = 0 then '1032' else '0' end, chr(10),
 '            Last_Error: ', case when event_type = 'error' and event_id % 97 = 0 then concat('Duplicate entry ', cast(event_id as string), ' for key PRIMARY') else '' end, chr(10),
 '         Last_IO_Error: ', case when event_id % 41 = 0 then 'error connecting: retry' else '' end, chr(10), '           Gtid_IO_Pos: 1-1-', cast(event_id as string), chr(10)) as dump from events

-- view: fx_queue_text
select event_id as sample_id, ts, case when event_id % 2 = 0 then 'A' else 'B' end as node,
 concat('Queued ', chr(39), 'sync', chr(39), ' requests        ', cast(cast(floor(value * 3) as bigint) as string), chr(10), 'Queued ', chr(39), 'high', chr(39), ' requests        ', cast(event_id % 5 as string), chr(10),
 'Queued ', chr(39), 'low', chr(39), ' requests         ', case when event_id % 31 = 0 then '-' else cast(event_id % 17 as string) end, chr(10), 'Queued ', chr(39), 'failed', chr(39), ' requests      ', cast(case when event_id % 43 = 0 then 2 else 0 end as string), chr(10),
 'Queued ', chr(39), 'full resync', chr(39), ' requests ', cast(event_id % 3 as string), chr(10), 'Waiting ', chr(39), 'failed', chr(39), ' requests     ', cast(case when event_id % 43 = 0 then 1 else 0 end as string), chr(10),
 'Total number of known users   ', cast(user_id as string)) as dump from events

-- view: fx_api
select n_nationkey as zone_no, concat('d', cast(n_nationkey as string), '.example.com') as zone,
 concat('{"data":[{"id":', cast(n_nationkey * 10 as string), ',"type":"MX","name":"","target":"sg1.example.com","ttl_sec":3600},{"id":', cast(n_nationkey * 10 + 1 as string), ',"type":"A","name":"mail","target":"203.0.113.10","ttl_sec":300}',
 case when n_nationkey % 7 <> 0 then concat(',{"id":', cast(n_nationkey * 10 + 2 as string), ',"type":"A","name":"mail","target":"198.51.100.20","ttl_sec":', case when n_nationkey % 4 = 0 then '3600' else '300' end, '}') else '' end,
 ',{"id":', cast(n_nationkey * 10 + 3 as string), ',"type":"A","name":"admin","target":"198.51.100.20","ttl_sec":300}]}') as payload from zone_seed

-- view: fx_probe
select concat('d', cast(n_nationkey as string), '.example.com') as zone, case when n_nationkey % 3 = 0 then 1 else 0 end as tunnel_ok, case when n_nationkey % 4 = 0 then 1 else 0 end as public_ok from zone_seed

-- view: fx_policy
select zone, case i when 0 then '_mta-sts' when 1 then 'mta-sts-policy' when 2 then '_smtp._tls' when 3 then '@' else '_imaps._tcp' end as name, case i when 1 then 'STS' when 3 then 'CAA' when 4 then 'SRV' else 'TXT' end as type,
 case i when 0 then 'v=STSv1; id=20260101000000Z' when 1 then concat('version: STSv1', chr(10), 'mode: enforce', chr(10), 'mx: sg1.example.com', chr(10), case when n % 5 = 2 then '' else concat('mx: us1.example.com', chr(10)) end, 'max_age: 604800')
  when 2 then 'v=TLSRPTv1; rua=mailto:tlsrpt@example.com' when 3 then (case when n % 9 = 4 then '0 issue "other-ca.example"' else '0 issue "letsencrypt.org"' end)
  else (case when n % 7 = 6 then '0 1 143 mail.example.net.' else concat('0 1 993 mail.', zone, '.') end) end as target
from (select n_nationkey as n, concat('d', cast(n_nationkey as string), '.example.com') as zone, explode(array(0, 1, 2, 3, 4)) as i from zone_seed) r
where case i when 0 then n % 6 <> 1 when 1 then n % 6 <> 1 when 2 then n % 8 <> 3 when 3 then n % 10 <> 5 else true end
union all select zone, name, type, target from fx_dns where name in ('_dmarc', '_pop3._tcp') or type = 'MX'

-- view: fx_folder
select doc_id, concat('u', cast(doc_id % 50 as string), '@d1.example.com') as username,
 case doc_id % 11 when 0 then 'Junk' when 1 then 'Spam' when 2 then 'Sent' when 3 then 'Sent Items' when 4 then 'Sent Messages' when 5 then 'Trash' when 6 then 'Deleted Items' when 7 then 'Drafts' when 8 then 'Archive' else concat('Project', cast(doc_id % 3 as string)) end as folder from documents

-- view: fx_password_change
select case when o_orderkey % 9 = 0 then upper(concat('u', cast(o_custkey as string), '@d', cast(c_nationkey as string), '.example.com')) else concat('u', cast(o_custkey as string), '@d', cast(c_nationkey as string), '.example.com') end as username,
 case when o_orderkey % 7 = 0 then cast(null as string) else concat('hash', cast(o_orderkey as string)) end as password, o_orderdate as changed, o_orderkey as seq
from orders join customer on c_custkey = o_custkey
union all select concat('ghost', cast(o_orderkey as string), '@nowhere.org'), 'x', o_orderdate, o_orderkey from orders where o_orderkey % 10 = 1

-- view: fx_vacation_msg
select event_id as msg_id, ts, concat('u', cast(user_id % 60 * 3 as string), '@d', cast(c_nationkey as string), '.example.com') as rcpt, concat('friend', cast(event_id % 40 as string), '@elsewhere.org') as sender
from events join customer on c_custkey = user_id % 60 * 3

-- view: fx_notified
select concat('u', cast(c_custkey as string), '@d', cast(c_nationkey as string), '.example.com') as on_vacation, concat('friend', cast(c_custkey % 40 as string), '@elsewhere.org') as notified, timestamp '2024-01-10 12:00:00' as notified_at from customer where c_custkey % 3 = 0

-- view: fx_bundle_file
select cast(floor(doc_id / 4) as bigint) as bundle, concat('f', cast(doc_id % 4 as string), '.pem') as name, text as content from documents where doc_id % 29 <> 0

-- view: fx_bundle_src
select cast(floor(doc_id / 4) as bigint) as bundle, concat('f', cast(doc_id % 4 as string), '.pem') as name, case when doc_id % 23 = 0 then concat(text, 'tampered') else text end as content from documents where doc_id % 31 <> 0

-- view: fx_session
select event_id, ts, concat('u', cast(user_id as string)) as username, case when event_id % 3 = 0 then concat('s', cast(cast(floor(event_id / 30) as bigint) as string)) else '' end as session_id from events

-- view: fx_smtp
select o_orderkey as session_no, o_orderkey % 17 = 0 as in_networks, o_orderkey % 5 = 0 as sasl_ok, o_orderkey % 20 = 0 as login_mismatch, o_orderkey % 7 = 0 as helo_invalid, o_orderkey % 11 = 0 as helo_not_fqdn,
 o_orderkey % 13 = 0 as client_unknown, o_orderkey % 19 = 0 as sender_not_fqdn, o_orderkey % 23 = 0 as sender_domain_unknown, o_orderkey % 29 = 0 as rcpt_not_fqdn, o_orderkey % 31 = 0 as rcpt_domain_unknown, o_orderkey % 3 <> 0 as dest_local, o_orderkey % 37 = 0 as rcpt_unlisted,
 o_orderkey % 41 = 0 as spf_fail, o_orderkey % 43 = 0 as pipelining, case when o_orderkey % 5 = 0 and o_orderkey % 4 = 0 then 'smtps' when o_orderkey % 5 = 0 and o_orderkey % 2 = 0 then 'submission' when o_orderkey % 47 = 0 then 'lmtp' else 'smtp' end as service from orders

-- view: fx_usage
select d.doc_id, concat('u', cast(c.c_custkey as string), '@d', cast(c.c_nationkey as string), '.example.com') as username, d.n_chars as vsize, timestamp '2024-01-01 00:00:00' + interval '1' minute * cast(d.doc_id as int) as saved_at,
 case d.doc_id % 8 when 0 then 'Junk' when 1 then 'Trash' else 'INBOX' end as folder from documents d join customer c on c.c_custkey = d.doc_id % 50

-- view: fx_dkim_txt
select zone, selector, case when published is null then cast(null as string) when length(zone) % 2 = 0 then concat('"v=DKIM1; k=rsa; p=', substr(published, 1, 200), '" "', substr(published, 201), '"') else concat('v=DKIM1; k=rsa; p=', published) end as txt from fx_dkim

-- view: fx_dns_more
select zone, name, type, prio, target, ttl from fx_dns
union all select case when i = 4 then 'example.com' else zone end, case i when 0 then 'mx' when 1 then '@' when 4 then 'us1' else 'sg1' end, case i when 0 then 'CNAME' when 1 then 'MX' else 'A' end, case when i = 1 then 20 else 0 end,
 case i when 0 then 'sg1.example.com.' when 1 then concat('mx.', zone, '.') when 2 then '203.0.113.10' when 3 then '203.0.113.11' else '198.51.100.20' end, 3600
from (select n_nationkey as n, concat('d', cast(n_nationkey as string), '.example.com') as zone, explode(array(0, 1, 2, 3, 4)) as i from zone_seed) r
where case i when 0 then n % 13 = 0 when 1 then n % 13 = 0 when 2 then n % 17 < 2 when 3 then n % 17 = 1 else n = 1 end

-- view: fx_sni_host
select o_orderkey as host_no, case when o_orderkey % 3 = 0 then concat('www', cast(o_orderkey % 9 as string), '.example.com') else concat('H', cast(o_orderkey % 260 as string), '.Example.com.') end as host from orders

-- view: fx_key_history
select concat('h', cast(p_partkey % 200 as string), '.example.com') as zone, case when p_partkey % 400 < 200 then 'sg' else 'us' end as node, concat('k', cast(p_partkey as string)) as selector,
 timestamp '2020-01-01 00:00:00' + interval '1' day * cast(floor(p_partkey / 200) as int) as valid_from,
 case when p_partkey % 11 = 0 then cast(null as timestamp) else timestamp '2020-01-01 00:00:00' + interval '1' day * cast(floor(p_partkey / 200) + 2 + p_partkey % 14 as int) end as removed_at, cast(p_partkey % 3 * 604800 as bigint) as ttl from part

-- view: fx_jail_present
select event_id, node, jail, cast(floor(date_part('day', ts)) as bigint) as day from fx_auth where outcome = 'fail'

-- view: fx_client
select event_id, ts, ip, case when outcome = 'fail' then 'connection' when outcome = 'ok' then 'message' else 'submission' end as kind from fx_auth

-- view: fx_login
select event_id, timestamp '2024-01-01 00:00:00' + interval '1' millisecond * (event_id * 50 - event_id % 3) as ts, ip, case when event_id % 2 = 0 then 'webmail_login' else 'admin_login' end as zone from fx_auth
